"""The stages against brute force, and the pipeline as a whole."""

import math
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from positdb.llm.common import BATCH_BYTES, stored

from .data import SCHEMA, rows, table
from .test_operators import brute_components


def test_stages(spark, tmp_path):
    found = rows(n=80)
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, found, extra=False)
    left = stored(stages["language"](spark, docs, ""), "t")
    letters = [r for r in found if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame(letters, SCHEMA).collect()))
    left = stored(stages["exact_dedup"](spark, left, ""), "t")
    first = {}
    for r in sorted(letters):
        first.setdefault(r[1], r)
    assert sorted(map(tuple, left.collect())) == sorted(first.values())
    left = stored(stages["near_dedup"](spark, left, ""), "t")
    kept = {i for i, (_, _, k) in brute_components(first.values(), 5).items() if k}
    assert {r.doc_id for r in left.collect()} == kept
    before = {r.doc_id: tuple(r) for r in left.collect()}
    left = stored(stages["mix"](spark, left, ""), "t")
    assert left.columns == docs.columns
    assert all(tuple(r) == before[r.doc_id] for r in left.collect())
    n = left.count()
    packed = stages["pack"](spark, left, "").collect()
    assert len({r.sequence_id for r in packed}) <= math.ceil(sum(r.length for r in packed) / 2048) + 1
    assert sum(r.piece == 0 for r in packed) == n


def test_run_and_empty_table(spark, tmp_path):
    for k, found in enumerate((rows(n=30), [])):
        folder = f"{tmp_path}/{k}"
        table(spark, found, extra=False).write.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == bool(found)


def test_mix_takes_rows_without_id(spark):
    """A source all of whose rows have no id is taken whole times: each row as often as its own words are covered."""
    found = [(None, f"text {i} " + "word " * (10 + i), "en", "b", i) for i in range(20)] + [(None, None, "en", "b", 99)]
    found += [(i, "other words " * 200, "en", "a", 0) for i in range(40)]
    left = stored(dict(corpus_pipeline.STAGES)["mix"](spark, table(spark, found, extra=False), ""), "t").collect()
    times = Counter(r.n_chars for r in left if r.source == "b")
    assert times == {i: 3 for i in range(20)} | {99: 1}


def test_language_without_labels(spark):
    found = [(i, t, None, s, n) for i, t, _, s, n in rows(n=30)]
    left = dict(corpus_pipeline.STAGES)["language"](spark, table(spark, found, extra=False), "").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(str(r) for r in found if r[1] and any(c.isalpha() for c in r[1]))


def test_copies_go_by_id_and_text(spark):
    """Of an id with two texts only the one that is a copy goes."""
    found = [(1, "one text", "en", "a", 0), (2, "one text", "en", "a", 0), (2, "a text of its own", "en", "a", 0), (3, "third", "en", "a", 0), (3, "third", "en", "a", 0)]
    left = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, table(spark, found, extra=False), "").collect()
    assert sorted(map(tuple, left)) == sorted({r for r in found if r[:2] != (2, "one text")})


def test_batches_for_python_end_by_bytes(spark):
    """10 000 rows of any length were one batch, which the JVM and a worker hold more than once each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = table(spark, rows(n=20), extra=False)
    long = spark.range(0, 60, 1, 1).selectExpr("repeat('0123456789', 20000) as text")
    for name in ("language", "near_dedup", "pack"):
        spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        sizes = [r.n for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) >= 12_000_000 and max(sizes) <= BATCH_BYTES + 250_000
    spark.conf.set(key, "1000")
    corpus_pipeline.bound_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)


def test_results_do_not_depend_on_batches(spark):
    """Batches of a few bytes, so of single rows, give what one batch of all rows gives."""
    docs, key, out = table(spark, rows(n=80), extra=False), "spark.sql.execution.arrow.maxBytesPerBatch", []
    stages = dict(corpus_pipeline.STAGES)
    for size in ("1", str(BATCH_BYTES)):
        spark.conf.set(key, size)
        left = docs
        for name in ("language", "near_dedup"):
            left = stored(stages[name](spark, left, ""), "t")
        packed = stages["pack"](spark, left, "").drop("sequence_id", "offset")
        out.append((sorted(map(str, left.collect())), sorted(map(str, packed.collect()))))
    spark.conf.unset(key)
    assert out[0] == out[1]
