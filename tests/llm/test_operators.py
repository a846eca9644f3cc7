"""Operators against brute force on small tables, with nulls, ties, copies, long texts and empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from positdb.llm import annforest, exactdedup, langid, lmscore, minhash, mixing, packing, quality, tokencount, toxicity
from positdb.llm.common import id_crc32, work_tables
from positdb.llm.queries import tokenizer_path

from .data import SCHEMA, WORDS, crc, rows, table

GPT, RANKS, CLIP = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def words(text):
    return (text or "").encode().lower().split()


# -- token counts --------------------------------------------------------------------------------------------------
def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(CLIP)
    want = sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, *_ in rows())
    assert sorted(map(tuple, tokencount.count_tokens(table(spark), CLIP, limit=50).collect())) == want
    assert tokencount.count_tokens(table(spark, []), CLIP).collect() == []


# -- packing -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, capacity):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(GPT)
    want = Counter()
    for i, t, *_ in rows():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        n = len(ids)
        cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack(table(spark), GPT, RANKS, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.03 * total / capacity + 1
    assert packing.pack(table(spark, []), GPT, RANKS, capacity).collect() == []


def test_distinct_parts_of_texts_are_merged_in_one_call():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(GPT), random.Random(0)
    odd = [" ", "  ", "\n", "\t", "\n\n", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "\r\n", "'s", "'", "é", "ß", "日本", "İ", "a\u0301", "🙂", "12", "x", "The", "!?", "\x00", "ɏ", "ɐ", "<|endoftext|>", "$", "\\", "y" * 1200]
    texts = [None, "", " ", "\n", " a", "a ", "a  b", *(t for _, t, *_ in rows())]
    texts += ["".join(rnd.choice(odd[:-3] if rnd.random() < 0.9 else odd) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    texts += [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", "\n", "\n\tx", "\xa0", "é"]) for _ in range(20)) for _ in range(300)]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for ranks in (RANKS, None):
        for kind in (pa.string(), pa.large_string()):
            assert list(packing.all_ids(packing.ChunkIds(GPT, ranks), pa.array(["unseen", *texts], type=kind)[1:])) == want
    known, calls = packing.ChunkIds(GPT, RANKS), []
    known.fast = lambda text, f=known.fast: calls.append(text) or f(text)
    assert len(list(packing.all_ids(known, pa.array([" ".join(f"w{i * j}" for i in range(500)) for j in range(9)])))) == 9
    assert len(calls) <= 2  # the parts behind blanks, and the one that begins all texts
    assert list(packing.all_ids(known, pa.array([], type=pa.string()))) == []
    assert list(packing.all_ids(known, pa.array([None, ""], type=pa.string()))) == [b"", b""]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_everything_and_is_near_the_bound(seed):
    rnd = random.Random(seed)
    histogram = Counter(min(300, int(rnd.expovariate(1 / 60)) + 1) for _ in range(rnd.choice([1, 50, 3000])))
    plan = packing.plan(histogram, 300)
    held = Counter()
    for found, n in plan:
        assert n > 0 and sum(x * m for x, m in found.items()) <= 300
        for x, m in found.items():
            held[x] += n * m
    assert held == histogram
    used, bound = sum(n for _, n in plan), math.ceil(sum(x * n for x, n in histogram.items()) / 300)
    assert bound <= used <= bound + 1 + bound // 200


@pytest.mark.parametrize("kind", ["exponential", "uniform", "long"])
def test_rounded_configurations_of_many_pieces(kind):
    """50 000 pieces: every sequence comes from the program; within 1 of the bound where sequences can be filled,
    else as few as best-fit decreasing makes, or 0.05 % more."""
    rnd = random.Random(1)
    draw = {"exponential": lambda: min(2047, int(rnd.expovariate(1 / 400)) + 1), "uniform": lambda: rnd.randint(1, 2047), "long": lambda: rnd.randint(500, 1500)}[kind]
    histogram = Counter(draw() for _ in range(50_000))
    plan = packing.plan(histogram, 2048)
    held = Counter()
    for found, n in plan:
        assert sum(x * m for x, m in found.items()) <= 2048
        for x, m in found.items():
            held[x] += n * m
    used, bound = sum(n for _, n in plan), math.ceil(sum(x * n for x, n in histogram.items()) / 2048)
    # Best-fit decreasing of the same pieces, for where the bound can't be reached.
    bins = [0] * 2049
    for x in sorted(histogram.elements(), reverse=True):
        room = next((r for r in range(x, 2049) if bins[r]), 0)
        bins[room] -= bool(room)
        bins[(room or 2048) - x] += 1
    assert held == histogram and used <= max(bound + 1, 1.0005 * sum(bins))


def test_knapsack_is_optimal():
    rnd = random.Random(4)
    for most in (99, 2):
        lengths = np.array(sorted(rnd.sample(range(2, 30), 6)))
        prices = np.array([rnd.random() * x for x in lengths])
        best = [0.0] * 41
        for x, p in zip(lengths.tolist(), prices.tolist()):
            for _ in range(min(most, 40 // x)):
                best = [max(best[w], best[w - x] + p if w >= x else 0.0) for w in range(41)]
        found = packing.best_configuration(lengths, prices, np.full(6, most), 40)
        assert sum(prices[j] * m for j, m in found.items()) == pytest.approx(max(best)) and max(found.values()) <= most


# -- near duplicates -----------------------------------------------------------------------------------------------
def brute_components(found, width, percent=80):
    def shingles(t):
        w = words(t)
        n = min(width, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()

    sets = {i: shingles(t) for i, t, *_ in found}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    found = rows(seed=width, n=120)
    want = brute_components(found, width)
    got = minhash.near_duplicates(table(spark, found), width=width).collect()
    assert len(got) == len(found)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_near_duplicate_chain_and_large_group(spark):
    """A chain whose ends are far apart, and a group in which not all are close to the smallest id."""
    base = [f"w{i}" for i in range(100)]
    chain = []
    for i in range(12):
        base = base[:]
        for j in range(4):
            base[(i * 8 + j) % 100] = f"c{i}x{j}"
        chain.append((i, " ".join(base), "en", "a", 0))
    group = [(100 + i, " ".join([*(f"g{k}" for k in range(60)), *(f"h{i % 7}y{k}" for k in range(5))]), "en", "a", 0) for i in range(40)]
    want = brute_components(chain + group, 2)
    got = minhash.near_duplicates(table(spark, chain + group), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert minhash.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("rounds", [1, 8])
def test_documents_around_a_passage(spark, monkeypatch, rounds):
    """Many are nearly similar enough, some pairs are, and few of these meet at a hub: the exact filter finds the others."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rnd = random.Random(21)
    found = []
    for group in range(2):
        passage = [f"p{group}x{i}" for i in range(70)]
        for i in range(45):
            words_ = passage[:]
            for _ in range(rnd.randint(1, 9)):  # changes that others may share
                at = rnd.randrange(70)
                words_[at] = f"q{group}x{at}x{rnd.randrange(2)}"
            found.append((1000 * group + i, " ".join(words_ + [f"own{rnd.randrange(40)}" for _ in range(rnd.randint(0, 4))]), "en", "a", 0))
    found += [(None, found[3][1], "en", "a", 0), (None, "nobody else says this", "en", "a", 0)]
    want = brute_components([r for r in found if r[0] is not None], 2)
    assert 10 < len({c for _, c, _ in want.values()}) < 80
    got = minhash.near_duplicates(table(spark, found), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.id: r.component for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_components_take_few_tables(spark):
    """The driver pays for every plan: a star takes one table, a path no more than its halvings and one."""
    star = [(7 if i % 2 else i, i if i % 2 else 7) for i in range(8, 60)] + [(8, 7), (7, 8), (8, 8)]
    path = [(i, i + 1) for i in range(200, 232)]
    for links, most in ((star, 1), (path, 6), (star + path, 6)):
        before = work_tables()
        found = minhash.components(spark.createDataFrame(links, "a long, b long"))
        assert work_tables() - before <= most
        want = {i: 7 for i in range(8, 60)} if links is star else {i: 200 for i in range(201, 233)} | ({i: 7 for i in range(8, 60)} if len(links) > 40 else {})
        assert sorted(map(tuple, found.collect())) == sorted(want.items())


def test_rounds_end_when_nothing_is_proposed(spark):
    """Two links in the first round, nothing to propose in the second: the exact filter comes next, not seven more rounds."""
    found = [(i, " ".join(f"w{i // 2}x{k}" for k in range(50)) + f" end{i % 2}", "en", "a", 0) for i in range(4)]
    found += [(10 + i, " ".join(f"part{k}" for k in range(n)), "en", "a", 0) for i, n in enumerate((101, 76))]  # one bucket, sizes too far apart
    before = work_tables()
    got = minhash.near_duplicates(table(spark, found), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(found, 2)
    assert work_tables() - before <= 20


def test_links_of_a_late_round(spark, monkeypatch):
    """A round that isn't worth another one: its links join those of the exact filter.  Streams come in small steps."""
    monkeypatch.setattr(minhash, "WORTH", 2)
    monkeypatch.setattr(minhash, "STEP", 3)
    found = rows(seed=3, n=120)
    got = minhash.near_duplicates(table(spark, found), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(found, 2)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    same = (minhash.signature(a, 1 << 16, 512) == minhash.signature(b, 1 << 16, 512)).mean()
    assert abs(same - 800 / 1200) < 0.1


# -- exact duplicates ----------------------------------------------------------------------------------------------
def brute_exact(found, best):
    groups = defaultdict(list)
    for i, t, *_ in found:
        groups[t or ""].append(i)
    return sorted((i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in found)


@pytest.mark.parametrize(("keep", "best"), [("smallest", min), ("largest", max)])
def test_exact_dedup(spark, keep, best):
    assert sorted(map(tuple, exactdedup.exact_dedup(table(spark), keep).collect())) == brute_exact(rows(), best)
    assert exactdedup.exact_dedup(table(spark, []), keep).collect() == []


def test_exact_dedup_in_many_batches(spark):
    """Batches of some ten rows: copies meet across runs and levels."""
    assert sorted(map(tuple, exactdedup.exact_dedup(table(spark), "smallest", batch_rows=10).collect())) == brute_exact(rows(), min)


def test_rows_without_id_never_stay_beside_others(spark):
    found = [(None, "a", "en", "s", 0), (4, "a", "en", "s", 0), (None, "b", "en", "s", 0), (None, "b", "en", "s", 0), (9, "c", "en", "s", 0)]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exactdedup.exact_dedup(table(spark, found), "largest").collect())
    assert got == [("4", "4", 2, True), ("9", "9", 1, True), ("None", "4", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "digest_of", lambda text: F.unhex(F.sha2(F.substring(text, 1, 2).cast("binary"), 256)))
    got = sorted(tuple(r)[:4] for r in exactdedup.exact_dedup(table(spark), "smallest").collect())
    assert got == [r[:4] for r in brute_exact(rows(), min)]


def test_index_merges_runs_and_looks_up(spark, tmp_path):
    index = exactdedup.LogStructuredIndex(spark, f"file://{tmp_path}/index", fanout=2)
    for k in range(3):
        index.flush(spark.createDataFrame([(bytes([i]), 100 * k + i) for i in range(k, 10)], "digest binary, id long"))
    assert [len(level) for level in index.levels] == [1, 1]  # two runs were merged, the third waits
    got = {bytes(r.digest): (r.id, r.entries) for r in index.compact().collect()}
    assert got == {bytes([i]): (i, min(i, 2) + 1) for i in range(10)} and len(index.paths) == 1
    assert [r.id for r in index.lookup([bytes([4])]).collect()] == [4]


# -- mixing --------------------------------------------------------------------------------------------------------
def highest_quotients(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment(spark, seed):
    rnd = random.Random(seed)
    groups = {g: [rnd.choice([0, rnd.random(), rnd.randint(1, 9), rnd.expovariate(0.001)]) for _ in range(rnd.randint(1, 40))] for g in range(5)}
    seats = {g: rnd.choice([0, 1, 7, 300]) for g in groups}
    df = spark.createDataFrame([(g, p, float(v), seats[g]) for g, vs in groups.items() for p, v in enumerate(vs)], "g int, p int, v double, m long")
    got = defaultdict(dict)
    for r in mixing.apportion(df, ["g"], "p", "v", "m").collect():
        got[r.g][r.p] = r.quota
    for g, vs in groups.items():
        assert [got[g][p] for p in range(len(vs))] == (highest_quotients(vs, seats[g]) if sum(vs) else [0] * len(vs))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark):
    found = rows(n=400)
    size = [len(words(t)) for _, t, *_ in found]
    sizes = Counter()
    for (_, _, _, s, _), n in zip(found, size):
        sizes[s] += n
    want = brute_targets(sizes)
    got = mixing.mix(table(spark, found), shards=4).collect()
    source = {i: s for i, _, _, s, _ in found}
    taken = Counter()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for (i, *_), n in zip(found, size))
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * 16 + 40, s
    again = mixing.mix(table(spark, found).repartition(7), shards=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.mix(table(spark, [])).collect() == []


def test_small_sources_come_near_their_targets(spark):
    found = [(i, " ".join(["w"] * n), "en", s, 0) for i, (s, n) in enumerate([("a", 4), ("a", 6), ("b", 5), ("c", 2), ("c", 3), ("d", 0), ("e", 900)])]
    got = mixing.mix(table(spark, [*found, (None, "two words", "en", None, 0)])).collect()
    taken, target = Counter(), {}
    for r, (_, t, _, s, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), [*found, (None, "two words", "en", None, 0)]):
        taken[s] += r.taken
        target[s] = r.target
    assert sum(target.values()) == pytest.approx(922) and target["d"] == 0
    assert all(abs(taken[s] - t) <= 1 + t / 50 for s, t in target.items()), (taken, target)


# -- nearest neighbours --------------------------------------------------------------------------------------------
def test_nearest_is_exact_where_all_are_candidates(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((90, 8)).round(2).tolist()
    vectors[5], vectors[6], vectors[7], vectors[8], vectors[9] = None, [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8
    vectors[11] = vectors[12] = vectors[13]  # ties
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in annforest.nearest(df, F.col("id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v in enumerate(vectors) if i not in range(5, 10)}
    assert set(got) == {i for i in ok if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(sum(a * b for a, b in zip(ok[q], v))), i) for i, v in ok.items() if i != q))[:7]
        assert [i for i, _ in found] == [i for _, i in want]
        assert [s for _, s in found] == pytest.approx([-s for s, _ in want], abs=1e-12)
    assert annforest.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def vectors_of(kind, n, dimension=64, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dimension))
    if kind == "clustered":
        v = v[rng.integers(0, max(2, n // 200), n)] + 0.05 * v
    if kind == "norms":
        v *= np.exp(0.5 * rng.standard_normal((n, 1)))
    return v


def recall(v, found, k=20):
    hits = 0
    for q, at in found.items():
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(at) & set(np.argsort(-score)[:k].tolist()))
    return hits / (k * len(found))


@pytest.mark.parametrize("kind", ["unstructured", "clustered", "norms"])
def test_forest_recall(kind):
    """At most a tenth of a block is checked."""
    v = vectors_of(kind, annforest.BLOCK)
    asked = np.arange(0, len(v), 160)
    found = dict(zip(asked.tolist(), annforest.Forest(v).candidates(v[asked], annforest.CANDIDATES)))
    assert np.mean([len(at) for at in found.values()]) <= 0.1 * len(v)
    assert recall(v, {q: at.tolist() for q, at in found.items()}) >= 0.9


@pytest.mark.parametrize("kind", ["unstructured", "clustered", "norms"])
def test_nearest_over_blocks_and_chunks(spark, kind):
    """Nine blocks, three chunks, 15 candidates of a hundred in each block; two dimensions are kept apart, null ids take no part."""
    v = vectors_of(kind, 4500)
    more = [(None, v[0].tolist()), *((i, [1.0] * 8) for i in range(10_000, 10_030))]
    df = spark.createDataFrame([*enumerate(v.tolist()), *more], "vec_id long, embedding array<double>").repartition(3)
    got, dims = defaultdict(list), set()
    for r in annforest.nearest(df, F.col("id") % 20 == 0, block=500, chunk=90, candidates=75).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        dims.add((r.query_id < 10_000, r.vec_id < 10_000))
    assert set(got) == {*range(0, 4500, 20), 10_000, 10_020} and dims == {(True, True), (False, False)}
    assert got[10_020] == [i for i in range(10_000, 10_030) if i != 10_020][:20]  # ties go to smaller ids
    assert recall(v, {q: at for q, at in got.items() if q < 10_000}) >= 0.9


def test_repeated_rows_are_candidates_each(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])] + [(1, [2.0, 1.0])] * 3 + [(2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = annforest.nearest(df, F.col("id") % 20 == 0, k=3).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, k, 1, 2.0) for k in (1, 2, 3)]


# -- classifiers ---------------------------------------------------------------------------------------------------
def test_language(spark):
    rnd = random.Random(5)
    own = {"en": WORDS, "fr": [w[::-1] + "é" for w in WORDS], "de": [w.upper() + "ßü" for w in WORDS]}
    found = [(i, " ".join(rnd.choices(own[lang], k=rnd.randint(3, 60))), lang, "a", 0) for i in range(300) for lang in [rnd.choice(list(own))]]
    odd = [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (1002, "123 !!", None, "a", 0)]
    df = table(spark, found + odd)
    got = {r.doc_id: r for r in langid.identify(df, id_crc32(F.col("id")) % 4 != 2).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    held = [(i, lang) for i, _, lang, *_ in found if crc(i) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert langid.identify(table(spark, []), F.lit(True)).collect() == []


def test_toxicity(spark):
    rnd = random.Random(6)
    bad = ["zoxious", "grumbletwit", "vilewort"]
    found, labels = [], []
    for i in range(400):
        w = rnd.choices(WORDS, k=rnd.randint(20, 80))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        found.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    found += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0)]
    labels += [(None, 1, 1), (3, None, None), (99999, 0, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, found), marks, id_crc32(F.col("id")) % 5 != 0).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if crc(i) % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[1000].predicted == got[1001].predicted == 0
    assert toxicity.toxicity(table(spark, []), marks, F.lit(True)).collect() == []
    assert {r.score for r in toxicity.toxicity(table(spark, found), marks.limit(0), F.lit(True)).collect()} == {0.5}


def test_quality(spark):
    rnd = random.Random(7)
    found = []
    for i in range(300):
        w = rnd.choices(WORDS, k=rnd.randint(60, 150))
        if i % 5 == 0:
            w = [x.upper() + "###$$" for x in w] if i % 2 else [w[0]] * len(w)
        found.append((i, " ".join(w), "en", "a", 0))
    got = {r.doc_id: r for r in quality.quality(table(spark, [*found, (1000, None, "en", "a", 0), (1001, "", "en", "a", 0)])).collect()}
    assert len(got) == 302
    assert all(got[i].kept for i in range(300) if i % 5) and not any(got[i].kept for i in range(300) if i % 5 == 0)
    assert quality.quality(table(spark, [])).collect() == []


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.random(20000) < 0.7
    patterns, keep = Counter(), []
    for y in truth:
        v = [(y if rng.random() < a else not y) * 1 if rng.random() < 0.8 else 2 for a in np.linspace(0.65, 0.95, len(quality.LABELLERS))]
        keep.append(sum(int(x) * 3**i for i, x in enumerate(v)))
    patterns.update(keep)
    post = quality.label_model(patterns)
    assert np.mean([(post[c] >= 0.5) == y for c, y in zip(keep, truth)]) > 0.93


# -- language model ------------------------------------------------------------------------------------------------
def test_lm_scores(spark):
    found = rows(n=150)
    train = [words(t) + [b"\n"] for i, t, *_ in found if crc(i) % 7 != 2]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    got = lmscore.score(table(spark, found), id_crc32(F.col("id")) % 7 != 2).collect()
    want = Counter()
    for i, t, *_ in found:
        tokens = words(t) + [b"\n"]
        want[i, len(tokens), sum(w in c for w in tokens), total, round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    seen = [r for r in got if crc(r.doc_id) % 7 != 2]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert lmscore.score(table(spark, []), F.lit(True)).collect() == []
    nothing = lmscore.score(table(spark, found), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing} == {(0, 0, 0.0, 0.0)}


def model_of_all(train):
    """The automaton of all n-grams of token lists, and the ids of its words."""
    c = Counter(w for t in train for w in t)
    ids = {w: i for i, w in enumerate(sorted(c))}
    base, grams = len(ids) + 1, []
    for n in (2, 3):
        g = Counter()
        for t in train:
            s = [base - 1, *(ids[w] for w in t)]
            g.update(sum(s[i + j] * base ** (n - 1 - j) for j in range(n)) for i in range(len(s) - n + 1))
        grams.append(sorted(g.items()))
    return lmscore.Automaton(np.array([float(c[w]) for w in sorted(c)]), len(train), sum(c.values()), len(c), grams), ids


@pytest.mark.parametrize("limits", [{}, {"dealt": 500, "hot": 20}])
def test_every_ngram_counts_however_large_the_corpus(spark, limits):
    """Pairs and triples seen once among 400 000 tokens are arcs; with small limits, common first words are spread."""
    found = rows(n=100) + [(5000, "filler words " * 200_000, "en", "a", 0), (None, "no id", "en", "a", 0)]
    train = [words(t) + [b"\n"] for i, t, *_ in found if i is not None and crc(i) % 7 != 2]
    assert any(i == 5000 and crc(i) % 7 != 2 for i, *_ in found)
    automaton, ids = model_of_all(train)
    want = sorted(round(automaton.traverse([ids.get(w, -1) for w in words(t) + [b"\n"]]), 4) for _, t, *_ in found)
    got = lmscore.score(table(spark, found), id_crc32(F.col("id")) % 7 != 2, **limits).collect()
    assert sorted(r.score for r in got) == pytest.approx(want, abs=1e-3)


def test_histories_are_distributions():
    """The probabilities of all words, and of one unknown word, sum to one in every state."""
    rnd = random.Random(9)
    k = 6
    seqs = [[k, *[min(k - 1, int(rnd.expovariate(0.5))) for _ in range(rnd.randint(1, 9))]] for _ in range(60)]
    counts = np.bincount([w for s in seqs for w in s[1:]], minlength=k).astype(float)
    base = k + 1
    grams = []
    for n in (2, 3):
        g = Counter(sum(s[i + j] * base ** (n - 1 - j) for j in range(n)) for s in seqs for i in range(len(s) - n + 1))
        grams.append(sorted((key, c) for key, c in g.items() if c >= 2))
    total = int(counts.sum())
    a = lmscore.Automaton(counts, len(seqs), total, k, grams)
    for s in range(len(a.arcs)):
        a.start = s
        mass = sum(10 ** a.traverse([w]) for w in range(k)) + 10 ** a.traverse([-1])
        assert mass == pytest.approx(1, abs=0.03 if s else 1e-9)


def test_work_tables_can_be_cleared(spark):
    from positdb.llm import common

    kept = common.stored(spark.range(3), "t")
    assert kept.count() == 3 and common.clear_work(spark) >= 1 and common.clear_work(spark) == 0


def test_lm_histories_are_asked_for_in_few_bytes(spark):
    """Questions about triples take less than a hash a history; passes share the tasks, and what was written before them is gone."""
    from positdb.llm import common

    rnd = random.Random(5)
    seqs = [[rnd.randrange(2, 3000) for _ in range(2)] for _ in range(40_000)]
    first, last = (np.array(x, dtype=np.uint64) for x in zip(*sorted({tuple(x) for x in seqs})))
    one = np.ones(len(first), dtype=np.int64)
    level = lmscore.Level((first, last), one, one, np.arange(len(first)), one.astype(np.uint64), one, one, -0.75, one < 0, one < 0, 4)
    asked = [list(level.asked(turn, 3)) for turn in range(3)]
    assert sorted(b for found in asked for b, _ in found) == [0, 1, 2, 3]
    assert sum(len(a) for found in asked for _, a in found) < 4 * len(first)
    before = common.work_tables()
    found = rows(n=100) + [(5000, "filler words " * 200_000, "en", "a", 0)]
    ids, train = id_crc32(F.col("id")) % 7 != 2, [words(t) + [b"\n"] for i, t, *_ in found if crc(i) % 7 != 2]
    automaton, numbers = model_of_all(train)
    got = lmscore.score(table(spark, found), ids, dealt=500).collect()
    want = sorted(round(automaton.traverse([numbers.get(w, -1) for w in words(t) + [b"\n"]]), 4) for _, t, *_ in found)
    assert sorted(r.score for r in got) == pytest.approx(want, abs=1e-3)
    assert common.work_tables() == before + 1 + sum(lmscore.PASSES.values())  # numbered chunks, passes of pairs and of triples


def test_lm_chunks_tokens_are_the_words():
    import pyarrow as pa

    odd = [b.to_bytes().decode() for b in range(128)]
    texts = [None, "", "  ", " a", "A b\t", "a\x0bB\x0c\x1cc\r\n", "É é\x85x\xa0y z İ", "x".join(odd), *odd]
    for kind in (pa.string(), pa.large_string()):
        for some in (pa.array(["unseen", *texts], type=kind)[1:], pa.array([None, " "], type=kind)):
            lengths, seq, kinds, names = lmscore.tokens(some)
            names, want = names.split(b" "), [words(t) for t in some.to_pylist()]
            assert lengths.tolist() == [len(t) + 2 for t in want] and kinds == len(names) == len(set(names))
            assert [[b"", *names][i] for i in seq.tolist()] == [x for t in want for x in [b"", *t, lmscore.END]]


def test_lm_positions_are_grouped_as_by_unique():
    rnd = np.random.default_rng(0)
    for keys in (np.zeros(0, dtype=np.int64), np.array([5]), rnd.integers(0, 50, 999), rnd.integers(0, 1 << 62, 99), rnd.integers(0, 1 << 64, 99, dtype=np.uint64)):
        found, first, of = lmscore.grouped(keys)
        want, number = np.unique(keys, return_inverse=True)
        assert (found == want).all() and (of == number).all() and (keys[first] == found).all()


def test_lm_questions_are_sorted_once_a_chunk(monkeypatch):
    """A chunk is built anew in every pass: n-grams aren't sorted again for each bucket, and words come in the order of their numbers."""
    rnd = np.random.default_rng(0)
    seq = np.concatenate([[0, *rnd.integers(2, 500, 5000), 1]]).astype(np.int32)
    codes = lmscore.hashes(np.frombuffer(names := b" ".join([lmscore.END, *(b"w%d" % i for i in range(2, 500))]), dtype=np.uint8))
    given = {b: lmscore.packed(at + 9, at < 0, rnd.permutation(len(at)) * 8 + b) for b, at in ((b, np.flatnonzero(codes % np.uint64(8) == b)) for b in range(8))}
    data = lmscore.packed(np.array([len(seq)]), np.array([True]), seq, np.ones(499), np.frombuffer(names, dtype=np.uint8))
    chunk = lmscore.Chunk(lmscore.numbered(data, given, 8), (1, 10**6, 8, 1e9), [], {})
    calls = []
    for name in ("lexsort", "union1d", "unique"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **b: calls.append(1) or f(*a, **b))
    assert len(list(chunk.pairs.asked(0, 1))) == 8 and calls == []
    assert (np.diff(chunk.codes.astype(np.int64)) >= 0).all()
