"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only.

* Memtables: entries (digest, id) come in batches of some ``BATCH_ROWS``.  Those of a batch are combined in the tasks' hash
  tables (partial aggregation), so that a text with any number of copies leaves one entry a task.
* Flush: every memtable becomes a run of level 0, Parquet files sorted by digest with a Bloom filter and min/max statistics
  on it, which point lookups (``LogStructuredIndex.lookup``) consult before they read a run.
* Compaction merges runs by digest and keeps the smallest (or largest) identifier and the number of entries.  ``FANOUT`` runs
  of a level become one of the next, so an entry is rewritten a logarithmic number of times; at the end all become one.
* Hits, digests with several entries, receive byte verification: their texts are read again and grouped by the text
  itself, so two texts that share a digest are never taken for copies.

Only hits move their text, and of a group of copies one text a task; nothing goes to the driver but two row counts,
which decide whether the groups found are small enough to broadcast (else both joins shuffle, where adaptive
execution splits a digest with very many copies).

Null texts count as empty.  Rows that share an id are one document: they get the same answers.  A null id never stays
unless all ids of its group are null.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from positdb.llm.common import new_folder, stored

#: Memtables that one batch is dealt to; each becomes a run.
MEMTABLES = 4
#: Entries of a batch, more or less, and runs of a level that are merged into one of the next.
BATCH_ROWS, FANOUT = 50_000_000, 4
#: Rows up to which found groups are broadcast: about 60 bytes each.
BROADCAST_ROWS = 500_000
#: Filters on the digests of a run's files, as large as the number of digests in the file asks for.
FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "1048576"}


class LogStructuredIndex:
    """Runs of (digest, id, entries) in a folder that all executors share, by levels."""

    def __init__(self, spark: SparkSession, folder: str, keep: str = "smallest", fanout: int = FANOUT) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.folder, self.fanout, self.runs = spark, folder, fanout, 0
        self.best = F.min if keep == "smallest" else F.max
        self.levels: list[list[str]] = [[]]
        self.kind = "long"

    @property
    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, merged: DataFrame) -> str:
        path = f"{self.folder}/run-{self.runs:05d}"
        self.runs += 1
        merged.sortWithinPartitions("digest").write.options(**FILTER).parquet(path)
        return path

    def flush(self, entries: DataFrame, memtables: int = MEMTABLES) -> None:
        """Add a batch of (digest, id); it becomes sorted runs, one for each memtable.  Full levels are merged."""
        dealt = entries.withColumn("memtable", F.pmod(F.xxhash64("digest"), F.lit(memtables)))
        self.kind = entries.schema["id"].dataType.simpleString()
        merged = dealt.groupBy("memtable", "digest").agg(self.best("id").alias("id"), F.count(F.lit(1)).alias("entries"))
        path = f"{self.folder}/flush-{self.runs:05d}"
        self.runs += 1
        merged.sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").options(**FILTER).parquet(path)
        self.levels[0].append(path)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged, self.levels[k] = self._write(self.merged(self.levels[k])), []
                self.levels[k + 1 :] = self.levels[k + 1 :] or [[]]
                self.levels[k + 1].append(merged)

    def entries(self, paths: list[str] | None = None) -> DataFrame:
        kind = f"digest binary, id {self.kind}, entries long"
        found = [self.spark.read.schema(kind).parquet(p).select("digest", "id", "entries") for p in paths or self.paths]
        return reduce(DataFrame.union, found)

    def merged(self, paths: list[str]) -> DataFrame:
        return self.entries(paths).groupBy("digest").agg(self.best("id").alias("id"), F.sum("entries").alias("entries"))

    def compact(self) -> DataFrame:
        """Merge all runs into one: a row a digest, with the id that stays."""
        self.levels = [[], [self._write(self.merged(self.paths))]]
        return self.entries()

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Point lookup; the predicate reaches the runs' filters."""
        return self.entries().where(F.col("digest").isin(digests))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its counted rows keep within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exact_dedup(docs: DataFrame, keep: str = "smallest", batch_rows: int = BATCH_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    log = stored(texts.select("id", "digest"), "digests")
    index = LogStructuredIndex(spark, new_folder(spark, "index"), keep)
    batches = max(1, -(-log.count() // batch_rows))
    for k in range(batches):
        index.flush(log.where(F.pmod(F.xxhash64(F.lit(1), "id", "digest"), F.lit(batches)) == k) if batches > 1 else log)
    copied = index.compact().where("entries > 1").select("digest")
    hits = texts.join(small(copied, copied.count()), "digest", "left_semi")
    # Byte verification: groups are made by the text itself.
    verified = stored(hits.groupBy("digest", "text").agg(index.best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "verified")
    groups = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    groups = stored(groups, "groups")
    counted = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("if(texts > 1, 1, 0)")).alias("clashes")).first()
    single = groups.where("texts = 1").select("digest", "keep_id", "group_size")
    if counted.clashes:
        # Some digest stands for several texts: its documents are told apart by their bytes.
        several = groups.where("texts > 1").select("digest")
        apart = texts.join(several, "digest", "left_semi").join(verified, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        plain = log.join(several, "digest", "left_anti").join(small(single, counted.n), "digest", "left").select("id", "digest", "keep_id", "group_size")
        found = plain.unionByName(apart)
    else:
        found = log.join(small(single, counted.n), "digest", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
