"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``:

* language: documents without any letter (language ``und``) go, whether or not the table labels any language.
* exact_dedup: of equal texts the document with the smallest id stays; of repeated rows one.
* near_dedup: of every group that links of five-word shingles connect, the smallest id stays.
* mix: a document is taken as often as its source's blocks cover it; the part of a document that is covered once more
  decides, by a seeded draw, whether the whole document is taken once more.  Documents without words stay.
* pack: what is left is packed into sequences; null texts are empty.

Null ids are never matched by the stages that drop rows by id, so such rows stay; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from positdb.llm import exactdedup, langid, minhash, mixing, packing
from positdb.llm.common import bound_batches, clear_work, new_folder, stored, table, work_tables
from positdb.llm.queries import tokenizer_path

#: Ids up to which a drop list is broadcast.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, *keys: str) -> DataFrame:
    """``docs`` without the ids (or ``keys``) of ``dropped``, broadcast only if their number is within the bound."""
    keys = keys or ("doc_id",)
    dropped = stored(dropped.select(*keys).distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, list(keys), "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    name = langid.classifier(docs, F.lit(True), unlearned="unlearned")
    return docs.withColumn("__language", name(F.col("text"))).where("__language.lang_pred != 'und'").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    flags = stored(exactdedup.exact_dedup(docs, keep="smallest"), "flags")
    repeated = stored(flags.groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id"), "repeated")
    # An id may stand for several texts, of which only some are copies.
    digest = F.lower(F.hex(exactdedup.digest_of(F.coalesce("text", F.lit("")))))
    copies = flags.where("not kept").withColumnRenamed("text_sha256", "__sha256")
    left = without(docs.withColumn("__sha256", digest), copies, "doc_id", "__sha256").select(docs.columns)
    if repeated.isEmpty():
        return left
    again = left.join(repeated.distinct(), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return without(left, repeated).unionByName(again)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return without(docs, minhash.near_duplicates(docs, width=5, percent=80).where("not kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Copies belong to rows, not to ids, which may be null or repeated; numbers of written rows hold.
    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "mixed")
    taken = mixing.mix(docs, carried=("__row",))
    times = taken.select("__row", F.col("size").alias("__size"), F.expr("if(size = 0, 0, taken / size)").alias("__covered"))
    found = docs.join(times.hint("shuffle_hash"), "__row")
    # Nulls leave a hash as it is: documents without id draw by their texts.
    share = F.pmod(F.xxhash64(F.lit(29), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 20)) / F.lit(1 << 20)
    times = F.when(F.col("__size") == 0, 1).otherwise(F.floor(F.col("__covered") + share)).cast("int")
    found = found.withColumn("__times", times).where("__times > 0")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select([c for c in docs.columns if c != "__row"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Language, near-duplicate and packing stages can't be expressed in SQL; brute-force tests cover the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way, and the stage before it, are deleted once it is done."""
    docs, since = table(spark, sf_dir, "documents"), work_tables()
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        clear_work(spark, since, keep=folder)
    return docs
