"""Classifiers and stages against slow versions of the same definitions, with repeated rows and very long texts."""

import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from positdb.llm import langid, mixing, quality, toxicity
from positdb.llm.common import stored

from .data import WORDS, rows, table


def prose(rnd, n, words=WORDS):
    return " ".join(rnd.choices(words, k=n))


# -- language ------------------------------------------------------------------------------------------------------
def kernel(a: str, b: str) -> float:
    """Blended spectrum of presence: for every length the common n-grams over the root of both numbers."""

    def grams(text, n):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        s = f" {' '.join(letters.split())} "
        return {s[i : i + n] for i in range(len(s) - n + 1)}

    out = 0.0
    for n in langid.LENGTHS:
        x, y = grams(a, n), grams(b, n)
        out += len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0
    return out


def test_language_scores_are_kernel_ridge_regression(spark):
    """The folded matrix gives what explicit kernels with the landmarks give, but for n-grams that share a column."""
    rnd = random.Random(11)
    own = {"en": WORDS, "xx": [w[::-1] + "é" for w in WORDS]}
    found = [(i, prose(rnd, rnd.randint(3, 30), own[lang]), lang, "a", 0) for i in range(60) for lang in [rnd.choice(list(own))]]
    found += [(100, prose(rnd, 30_000), "en", "a", 0), found[3], found[3]]
    df = table(spark, found)
    texts, langs = langid.sample(df, F.lit(True), "doc_id", "text", "lang", langid.SAMPLE)
    assert sorted(zip(texts, langs)) == sorted((t, lang) for _, t, lang, *_ in found)  # fewer than the sample's bound
    names = sorted(own)
    chosen = [t for name in names for t in [t for t, lang in zip(texts, langs) if lang == name][: langid.LANDMARKS]]
    k = np.array([[kernel(t, m) for m in chosen] for t in texts])
    own_kernel = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    goal = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    share = np.array([1 / langs.count(lang) for lang in langs])[:, None]
    alpha = np.linalg.lstsq(k.T @ (share * k) + langid.RIDGE * own_kernel + 1e-9 * np.eye(len(chosen)), k.T @ (share * goal), rcond=None)[0]
    got = {r.doc_id: r for r in langid.identify(df, F.lit(True)).collect()}
    for i, t, *_ in found:
        value = np.array([kernel(t, m) for m in chosen]) @ alpha
        odds = np.exp(4 * (value - value.max()))
        assert got[i].lang_pred == names[int(value.argmax())]
        assert got[i].score == pytest.approx(float((odds / odds.sum()).max()), abs=0.02)


# -- quality -------------------------------------------------------------------------------------------------------
def slow_label_model(votes: list[list[int]], rounds: int = 200) -> list[float]:
    """Expectation-maximisation document by document."""
    good = [(v.count(1) + 0.5) / (v.count(1) + 2 * v.count(0) + 1.0) for v in votes]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(votes) + 2)
        table = {}
        for j in range(len(votes[0])):
            for y in (0, 1):
                weight = [sum((g if y else 1 - g) for g, v in zip(good, votes) if v[j] == k) + 1.0 for k in (0, 1)]
                table[j, y] = [w / sum(weight) for w in weight]
        new = []
        for v in votes:
            p = [1 - prior, prior]
            for y in (0, 1):
                for j, k in enumerate(v):
                    p[y] *= table[j, y][k] if k != 2 else 1.0
            new.append(p[1] / (p[0] + p[1]))
        done = max(abs(a - b) for a, b in zip(good, new)) < 1e-9
        if done:
            break
        good = new
    return good


def test_quality_is_the_slow_version(spark):
    rnd = random.Random(12)
    found = [(i, prose(rnd, rnd.randint(1, 90)) + rnd.choice(["", " ###" * 30, " 12345" * 40, "\nmore\nmore\nmore"]), "en", "a", 0) for i in range(80)]
    found += [(200, prose(rnd, 20_000), "en", "a", 0), (201, None, "en", "a", 0), found[5], found[5]]
    texts = [(t or "").encode() for _, t, *_ in found]
    votes = [[quality.votes(t) // 3**j % 3 for j in range(len(quality.LABELLERS))] for t in texts]
    posterior = slow_label_model(votes)
    weights, bias = quality.fit(sorted(texts), [p for _, p in sorted(zip(texts, posterior))])
    got = quality.quality(table(spark, found)).collect()
    assert len(got) == len(found)
    want = {}
    for (i, *_), t, p in zip(found, texts, posterior):
        cells = Counter()
        for w in quality.tokens(t):
            for c in quality.Cells()[w]:
                cells[c] += 1
        z = sum(weights[c] * n for c, n in cells.items()) / (sum(cells.values()) or 1) + bias
        want[i] = (p, 1 / (1 + math.exp(-z)))
    for r in got:
        assert r.label_prob == pytest.approx(want[r.doc_id][0], abs=1e-6)
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-4)
        assert r.kept == (r.label_prob >= quality.CUT or r.score >= quality.CUT)


# -- toxicity ------------------------------------------------------------------------------------------------------
def test_toxicity_scores_are_the_slow_version(spark):
    """Windows cut by hand and compressed one by one with compressors of their own."""
    rnd = random.Random(13)
    bad = ["zoxious", "grumbletwit", "vilewort"]
    found, labels = [], []
    for i in range(120):
        toxic = i % 3 == 0
        found.append((i, prose(rnd, rnd.randint(20, 60), WORDS + bad * 8 * toxic), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    found += [(500, prose(rnd, 20_000) + " vilewort", "en", "a", 0), (501, None, "en", "a", 0), (502, "", "en", "a", 0), (503, "x" * 50_000, "en", "a", 0), found[0], found[0]]
    df, marks = table(spark, found), spark.createDataFrame(labels + labels[:9], "doc_id long, quality int, toxic int")
    texts, counts = toxicity.sample(df, marks, F.lit(True), "doc_id", "text", "toxic", {1: 1500, 0: 1500}, 1 << 24)
    assert counts == {1: 40, 0: 80} and sorted(texts[1]) == sorted(t.encode() for (i, t, *_), (_, _, y) in zip(found, labels) if y)
    toxic, ordinary, common, w = toxicity.learn(texts[1], texts[0], (40, 80))

    def length(window, own):
        known = zstandard.ZstdCompressionDict(own + common + toxicity.BEFORE + toxicity.AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_LAZY2)
        known.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(toxicity.BEFORE + b" " + window + b" " + toxicity.AFTER))

    got = {r.doc_id: r.score for r in toxicity.toxicity(df, marks, F.lit(True)).collect()}
    for i, t, *_ in [*found[:12], *found[121:124]]:
        distances, words = [], (t or "").lower().encode().split()
        while words:
            window = [words.pop(0)]
            while words and len(b" ".join(window)) + 1 < toxicity.WINDOW:
                window.append(words.pop(0))
            distances.append(length(b" ".join(window), ordinary) - length(b" ".join(window), toxic))
        d = [max(-8, min(8, x)) for x in distances]
        n = max(1, len(d))
        beyond = [sum(x >= k for x in d) for k in (2, 3, 4, 6)] + [sum(x <= -3 for x in d)]
        z = w @ [1.0, *map(math.log1p, beyond), *(k / n for k in beyond), max([0, *d]), math.log1p(len(d))]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), i
    assert sum(got[i] >= 0.5 for i in range(0, 120, 3)) >= 36 and sum(got[i] >= 0.5 for i in range(120) if i % 3) <= 4


# -- stages --------------------------------------------------------------------------------------------------------
def spark_xxhash64(*values: int) -> int:
    seed = 42
    for k, v in enumerate(values):
        seed = xxhash.xxh64(struct.pack("<i" if k == 0 else "<q", v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def test_copies_of_each_document(spark):
    """How often the mix stage takes a document follows from its words taken and a draw; repeated rows are taken each."""
    found = [(i, f"text {i} " + "word " * (5 + i % 50), "en", "abc"[i % 7 % 3], i) for i in range(150)] + [(7, "text of a repeated id", "en", "a", 7)]
    docs = table(spark, found, extra=False)
    left = Counter(r.n_chars for r in stored(dict(corpus_pipeline.STAGES)["mix"](spark, docs, ""), "t").collect())
    want = Counter()
    for r in mixing.mix(docs.withColumn("key_", F.col("n_chars")), carried=("n_chars",)).collect():
        draw = spark_xxhash64(29, r.doc_id) % (1 << 20) / (1 << 20)
        want[r.n_chars] += math.floor(r.taken / r.size + draw) if r.size else 1
    assert left == Counter({k: n for k, n in want.items() if n})


def test_stages_stand_null_ids_and_extra_columns(spark):
    """Rows without id are dropped by no stage that drops by id; other columns come through whatever their names."""
    found = [*rows(n=30), (None, "a text without id of its own", "en", "a", 1), (None, "a text without id of its own", "en", "a", 2), (None, None, None, None, None)]
    docs = stored(table(spark, found), "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stored(stage(spark, docs, ""), "t")
        assert left.columns == docs.columns, name
        extra = left.select("id", "rank", "bucket", "keep_id").distinct().collect()
        assert [tuple(r) for r in extra] == [("clash",) * 4], name
        alone = left.where("doc_id is null and text is not null").count()
        assert alone >= (1 if name != "mix" else 0), name
        docs = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == docs.count()


def test_pipeline_run_is_its_stages(spark, tmp_path):
    """``run`` gives the rows of its stages applied one after the other, and leaves one work table."""
    from positdb.llm import common

    table(spark, rows(n=25), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    before = common.work_tables()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert common.work_tables() == before + 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "t")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, docs.select(*key).collect()))
