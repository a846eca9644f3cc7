"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from positdb.llm import annforest, exactdedup, langid, lmscore, minhash, mixing, packing, quality, tokencount, toxicity
from positdb.llm.common import id_crc32, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_crc32(F.col("doc_id")) % 4 == 2
    found = langid.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.toxicity(docs, labels, id_crc32(F.col("id")) % 5 != 0)
    held_out = id_crc32(F.col("doc_id")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.score(table(spark, sf_dir, "documents"), id_crc32(F.col("id")) % 7 != 2)
    held_out = id_crc32(F.col("doc_id")) % 7 == 2
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_near_duplicates": op2_near_duplicates, "op3_nearest": op3_nearest, "op4_quality": op4_quality, "op5_language": op5_language, "op6_mix": op6_mix, "op7_exact_dedup": op7_exact_dedup, "op8_toxicity": op8_toxicity, "op9_lm_score": op9_lm_score, "op10_token_counts": op10_token_counts}


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sized AS (
    SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets
), classes AS (
    SELECT min(doc_id) AS doc_id, n, s FROM sized WHERE n > 0 GROUP BY n, s
), items AS (
    SELECT doc_id, n, unnest(s) AS g FROM classes
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count_g, g) AS place
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS count_g FROM items)
), firsts AS (
    SELECT doc_id, n, g FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1
), pairs AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM firsts a JOIN firsts b USING (g)
    WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
    SELECT a, b FROM pairs JOIN classes x ON x.doc_id = a JOIN classes y ON y.doc_id = b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS r FROM classes UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r
), found AS (
    SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, coalesce(f.component_id, z.doc_id) AS component_id, z.doc_id = coalesce(f.component_id, z.doc_id) AS kept
FROM sized z LEFT JOIN classes c ON c.n = z.n AND c.s = z.s LEFT JOIN found f ON f.doc_id = c.doc_id
"""

OP3_SQL = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2_SQL, "op3_nearest": OP3_SQL, "op7_exact_dedup": OP7_SQL}
