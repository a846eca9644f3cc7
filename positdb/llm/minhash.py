"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

* A document's set holds the 64-bit hashes of its distinct word shingles.  Documents with equal sets form a class,
  represented by its smallest id, so exact copies cost one row from here on.
* Signature: two permutations generate all coordinates.  The first maps a shingle to a cell of a fixed table; the
  second permutes the cells, and coordinate k sees it shifted circularly by k.  Because a shingle's values for all
  coordinates are then neighbours in the permuted table, a signature is a minimum over contiguous slices.
* Bands of ``ROWS`` coordinates become 64-bit keys.  At a similarity of 0.8 the chance that no band of ``BANDS``
  agrees is (1 - 0.8 ** ROWS) ** BANDS: two in a million.
* Proposals: in every bucket that holds several components, a hub is chosen (the smallest id, later one drawn by a hash
  of the bucket and the round), and a member outside the hub's component counts it as a partner.  A document proposes
  one partner a round, that with most buckets in common, so a round has a pair a document at most, however large a
  group of near copies is.  Pairs are confirmed on full sets and components are joined; rounds go on while
  they find links.  The few links of the last round wait for those of the next step.
* What is left are documents of different components in one bucket, mostly ones that share a passage and are not
  similar enough.  They are not paired.  ``peeled`` gives every bucket's members to the group of its heaviest
  component and takes from all sets of a group what most of them hold: the distance of two sets is the distance of
  what remains, X = set xor common part.  With e = |X| - |set| * (100 - p) / (100 + p), two documents are linked
  exactly if their X have (e + e') / 2 elements in common.  So, with documents in classes by e, they share one of the
  first |X| - t + 1 elements of X, rare ones first, t the least number that the other's class permits: an exact prefix
  filter, in which documents that merely share a passage part, because they have to agree in what differs.  Whoever
  has e + e' <= 0 is linked without a look.  Candidates are confirmed on full sets.  So no link between documents that
  share a bucket is lost.

Sets meet as a stream: a group's common part (or a hub's set) comes first, then the members one by one, dealt to tasks of
some ``SALTED`` members, so a task holds one such set and one batch.  Bucket statistics are partial aggregates, all joins
on buckets and ids are plain equi-joins that adaptive execution can split.  What the driver gets are row counts and ids to
broadcast.  Every exchange of a plan costs it a thread for a minute, and generated code; so steps with few rows have few.

Null texts and texts without words have the empty set: size 0, linked with nothing.  With fewer words than a shingle
takes, the whole sequence is the one shingle.  Rows that share an id are taken for one document's copies.  A row without id
has the component of rows with an equal set, if one of these has an id, and is linked with nothing else.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from positdb.llm.common import map_arrow, stored, utf8

ROWS, BANDS = 8, 72
#: Cells of the permuted table (a power of two).
CELLS = 1 << 20
#: Remembered words of a worker; beyond that it starts anew.
REMEMBERED = 300_000
#: Rounds of proposals at most (what they leave is exact), and links for a proposal that make another one worth while.
ROUNDS, WORTH = 8, 0.05
#: Members that a set which comes before them is repeated for.
SALTED = 64
#: Rows of a stream that are taken at once: each can give hundreds.
STEP = 512
#: A group's shingles are told apart by frequency from this share of its members on.
FREQUENT = 1 / 32
#: Bounds of classes of e, in shingles: two an octave.
GRID = np.array(sorted({s * x for k in range(40) for x in (0, 1, 1 << k, 3 << k) for s in (-1, 1)}), dtype=np.int64)
#: Rows up to which ids are broadcast: about 20 bytes each.
BROADCAST_ROWS = 1_000_000


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of a common hash function)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes of a text: ASCII-lower-cased words, ``width`` at a time."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.width, len(h))
        if not n:
            return h
        out = mixed(np.full(len(h) - n + 1, n, dtype=np.uint64))  # the number of words tells short sequences apart
        for i in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(out)


@lru_cache(maxsize=1)
def permuted(cells: int, coordinates: int) -> np.ndarray:
    """The second permutation, with its start repeated at the end, as overlapping slices: row c is what cell c shows."""
    table = np.random.Generator(np.random.PCG64(20)).permutation(cells).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, cells: int, coordinates: int) -> np.ndarray:
    slices = permuted(cells, coordinates)
    at = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(cells - 1)  # the first permutation
    out = np.full(coordinates, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(at), 512):
        np.minimum(out, slices[at[i : i + 512]].min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, width: int, rows: int, bands: int, cells: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), c1, c2 (128-bit digest of the set) and the band keys of every document."""
    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = slim.schema["id"].dataType.simpleString()

    def make():
        import xxhash

        shingle = Shingler(width)
        powers = mixed(np.arange(1, rows + 1, dtype=np.uint64))

        def work(batch):
            sizes, c1, c2, keys = [], [], [], []
            for text in utf8(batch, "text"):
                s = shingle(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s)), c1.append(int.from_bytes(digest[:8], "big", signed=True)), c2.append(int.from_bytes(digest[8:], "big", signed=True))
                if len(s):
                    sig = signature(s, cells, rows * bands).astype(np.uint64).reshape(bands, rows)
                    keys.append(mixed((mixed(sig + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            values = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            return {"id": batch.column("id"), "n": sizes, "c1": c1, "c2": c2, "bands": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(values))}

        return work

    return map_arrow(slim, make, f"id {kind}, n long, c1 long, c2 long, bands array<long>")


def sets(docs: DataFrame, ids: DataFrame, n: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """id and shingles of the documents whose id is in ``ids`` (one row an id, ``n`` in all)."""
    wanted = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").join(wanted, "id", "left_semi")
    kind = slim.schema["id"].dataType.simpleString()

    def make():
        shingle = Shingler(width)

        def work(batch):
            found = [shingle(t) for t in utf8(batch, "text")]
            ends = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            return {"id": batch.column("id"), "shingles": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(values))}

        return work

    return map_arrow(slim, make, f"id {kind}, shingles array<long>")


def full_sets(ids: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The sets of the ids in the one column of ``ids``, one row an id even if ids repeat in the table; written."""
    n = ids.count()
    full = stored(sets(docs, ids, n, width, id_col, text_col), "sets")
    return stored(full.groupBy("id").agg(F.first("shingles").alias("shingles")), "sets") if full.count() > n else full


def streamed(heads: DataFrame, members: DataFrame, n: int, full: DataFrame, make: Callable[[dict, np.ndarray], Callable[[dict, np.ndarray], Iterator[tuple]]], schema: str) -> DataFrame:
    """What ``make(head, its data)`` makes of each of its members, one by one, and their sets, as rows of ``schema``.

    ``heads`` has a row a key with ``data`` (array<long>), ``members`` ``n`` rows of ``key`` and ``id``; both with what else is asked
    of them.  Heads without members are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    light = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    salts = light(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts")))
    heads = heads.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("tag", F.lit(0))
    members = members.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).withColumn("tag", F.lit(1))
    members = full.withColumnRenamed("shingles", "data").join(light(members), "id")
    rows = heads.drop("salts").unionByName(members.drop("salts"), allowMissingColumns=True)
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "tag")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            names = [c for c in batch.schema.names if c != "data"]
            data = batch.column("data")
            values, ends = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
            found: list[tuple] = []
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in names])):
                row, own = dict(zip(names, row)), values[ends[i] : ends[i + 1]]
                if row["tag"] == 0:
                    work = make(row, own.copy())
                else:
                    found.extend(work(row, own))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*found)) or [()] * len(target), target)], schema=target)

    return rows.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, n: int, full: DataFrame, percent: int) -> DataFrame:
    """Of ``n`` pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""
    heads = full.select(F.col("id").alias("key"), F.col("shingles").alias("data"))
    members = pairs.select(F.col("a").alias("key"), F.col("b").alias("id"))
    kind = dict(pairs.dtypes)["a"]

    def make(head: dict, hub: np.ndarray):
        hub = np.sort(hub)

        def linked(row: dict, own: np.ndarray) -> Iterator[tuple]:
            both = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum())
            if 100 * both >= percent * (len(hub) + len(own) - both):
                yield row["key"], row["id"]

        return linked

    return streamed(heads, members, n, full, make, f"a {kind}, b {kind}")


def peeled(still: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that need no look, and candidates (a, b), among members (bucket, id, n, component) of open buckets."""
    # Every bucket goes to the group of that of its components which has most rows in open buckets.
    weights = still.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    per = still.select("bucket", "component").distinct().join(weights, "component")
    mains = per.groupBy("bucket").agg(F.max_by("component", F.struct("weight", "component")).alias("key"))
    groups = stored(still.join(mains, "bucket").select("key", "id", "n", "component").distinct(), "groups")
    kind = dict(groups.dtypes)["id"]
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    rows = groups.count()
    dealt = F.broadcast(groups) if rows <= BROADCAST_ROWS else groups
    counts = full.join(dealt, "id").select("key", F.explode("shingles").alias("g")).groupBy("key", "g").agg(F.count(F.lit(1)).alias("k"))
    frequent = counts.join(sizes, "key").where(F.col("k") >= F.greatest(F.lit(2), F.col("members") * FREQUENT))
    # At most 1 / FREQUENT times the mean size of a group's sets.
    heads = frequent.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("g", "k"))).alias("f"), F.first("members").alias("members"))
    heads = sizes.select("key").join(heads, "key", "left").select("key", F.expr("coalesce(transform(f, x -> x.g), array())").cast("array<long>").alias("data"), F.expr("transform(f, x -> x.k)").alias("counts"), "members")
    heads = stored(heads, "heads")
    whole, part = 100 + percent, 100 - percent

    def apart(head: dict, g: np.ndarray):
        """A function from a set to its X, rare elements first."""
        if not len(g):
            return np.sort
        members, k = head["members"], np.array(head["counts"], dtype=np.int64)
        common = 2 * k > members

        def x_of(own: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(g, own), len(g) - 1)
            known = g[at] == own
            missing = common.copy()
            missing[at[known]] = False
            extra = ~(known & common[at])
            x = np.concatenate([own[extra], g[missing]])
            often = np.concatenate([np.where(known, k[at], 1)[extra], (members - k)[missing]])
            return x[np.lexsort((x, often))]

        return x_of

    def measure(head: dict, g: np.ndarray):
        x_of = apart(head, g)

        def of(row: dict, own: np.ndarray) -> Iterator[tuple]:
            a = len(x_of(own))
            e = whole * a - part * row["n"]
            yield row["key"], row["id"], row["n"], row["component"], a, e, int(np.searchsorted(GRID, e // whole, side="right"))

        return of

    measured = stored(streamed(heads, groups, rows, full, measure, f"key {kind}, id {kind}, n long, component {kind}, a long, e long, class int"), "measured")
    nearest = measured.groupBy("key").agg(F.min(F.struct("e", "id", "component")).alias("m"))
    certain = measured.join(nearest, "key").where("component != m.component and e + m.e <= 0").select(F.least("id", "m.id").alias("a"), F.greatest("id", "m.id").alias("b"))
    there = measured.groupBy("key", "class").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("e").alias("e0"), F.max("e").alias("e1"), F.max("a").alias("a1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    there = there.groupBy("key").agg(F.collect_list(F.struct("class", "c0", "c1", "e0", "e1", "a1", "n0", "n1")).alias("there"))  # a row a class of the grid

    def first_ones(head: dict, g: np.ndarray):
        x_of, there = apart(head, g), head["there"]
        salt = mixed(np.array([zlib.crc32(str(head["key"]).encode())], dtype=np.uint64))

        def of(row: dict, own: np.ndarray) -> Iterator[tuple]:
            x, n = x_of(own), row["n"]
            a, e = len(x), whole * len(x) - part * n
            mine = int(np.searchsorted(GRID, e // whole, side="right"))
            for t in there:
                least = max(1, -(-(e + t["e0"]) // (2 * whole)))
                fits = 100 * t["n1"] >= percent * n and percent * t["n0"] <= 100 * n
                if not fits or e + t["e1"] <= 0 or least > min(a, t["a1"]) or t["c0"] == t["c1"] == row["component"]:
                    continue
                low, high = sorted((mine, t["class"]))
                keys = mixed(mixed(x[: a - least + 1].view(np.uint64) ^ mixed(np.array([low * 4096 + high], dtype=np.uint64))) + salt).view(np.int64).tolist()
                for role in {mine > low, mine == high}:
                    for key in keys:
                        yield key, role, row["id"], n, row["component"], e

        return of

    keyed = streamed(heads.join(there, "key"), groups, rows, full, first_ones, f"key long, role boolean, id {kind}, n long, component {kind}, e long")
    keyed = stored(keyed, "firsts")
    left, right = (keyed.where(F.col("role") == r).select("key", *[F.col(c).alias(f"{c}{s}") for c in ("id", "n", "component", "e")]) for r, s in ((False, "0"), (True, "1")))
    sized = f"100 * least(n0, n1) >= {percent} * greatest(n0, n1)"
    pairs = left.join(right, "key").where("component0 != component1 and e0 + e1 > 0").where(sized)
    return certain, pairs.select(F.least("id0", "id1").alias("a"), F.greatest("id0", "id1").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``links`` (a, b) but the smallest of each component.

    Alternates large-star and small-star steps: every step hangs neighbours on the smallest one, so a component of n
    ids becomes a star after some log n rounds.  A step is a sort by ends: the first neighbour is the smallest.  Each
    round is written, so lineage stays short.
    """
    ends = lambda x, y: F.struct(F.col(x).alias("a"), y.alias("b"))
    by = Window.partitionBy("a").orderBy("b")
    edges = links.where("a != b")
    while True:
        # large star: neighbours above a node move to the least of its neighbourhood
        both = edges.select(F.inline(F.array(ends("a", F.col("b")), ends("b", F.col("a")))))
        large = both.withColumn("m", F.least("a", F.first("b").over(by))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and the neighbours below it move to the least of these
        below = large.withColumn("m", F.first("b").over(by)).withColumn("before", F.lag("b").over(by)).where("before is null or before != b")
        edges = stored(below.select(F.expr("if(before is null, a, b)").alias("a"), F.col("m").alias("b")), "links")
        # stars: who hangs on a node hangs on no other one, and nobody hangs on them
        roles = edges.select(F.inline(F.array(ends("a", F.col("b")), ends("b", F.lit(None).cast(dict(edges.dtypes)["b"])))))
        roles = roles.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.count("b").alias("up"), F.count(F.lit(1)).alias("all"))
        if not roles.where("x != y or up > 0 and up < all").count():
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, component after ``links`` (a, b) join components of ``found``; only ends of links move."""
    if found is None:
        return stored(components(links), "components")
    for x in "ab":
        own = found.select(F.col("id").alias(x), F.col("component").alias("c"))
        links = links.join(own, x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    moved = stored(components(links), "moved")
    kept = found.join(moved.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    return stored(kept.select("id", F.coalesce("now", "component").alias("component")).union(moved.select("id", "component")), "components")


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, id, n, component of the members of buckets that hold more than one component; written."""
    labelled = members.select("bucket", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = stored(labelled, "labelled")
    several = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
    return stored(labelled.join(several, "bucket", "left_semi"), "open")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    sketch = stored(sketches(docs, width, rows, bands, cells, id_col, text_col), "sketches")
    classes = sketch.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "classes")
    copied = classes.where("copies > 1").select("c1", "c2", "n", F.col("id").alias("first"))
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    # One row a class: single documents as they are, of copies the first.
    marked = sketch.where("n > 0 and id is not null").join(copied, ["c1", "c2", "n"], "left")
    firsts = marked.where("id = first").groupBy("id", "n", "c1", "c2").agg(F.first("bands").alias("bands"))
    members = marked.where("first is null").select("id", "n", "bands").union(firsts.select("id", "n", "bands"))
    members = members.select("id", "n", F.explode("bands").alias("bucket"))
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket"), "shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    still = stored(members.join(shared, "bucket", "left_semi").withColumn("component", F.col("id")), "open")
    full = full_sets(stored(still.select("id").distinct(), "compared"), docs, width, id_col, text_col)
    found = tested = late = None
    for k in range(ROUNDS):
        if still.isEmpty():
            break
        drawn = F.xxhash64(F.lit(k), "bucket", "id") if k else F.col("id")
        hubs = still.groupBy("bucket").agg(F.min_by(F.struct("id", "n", "component"), drawn).alias("h"))
        votes = still.join(hubs, "bucket").where("component != h.component").where(f"100 * least(n, h.n) >= {percent} * greatest(n, h.n)")
        votes = votes.groupBy("id", F.col("h.id").alias("hub")).agg(F.count(F.lit(1)).alias("k")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), "id", "k")
        if tested is not None:
            votes = votes.join(tested, ["a", "b"], "left_anti")
        pairs = votes.groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("k", F.xxhash64("a", "b"))).alias("p"))
        pairs = stored(pairs.select("p.a", "p.b").distinct(), "pairs")
        asked = pairs.count()
        if not asked:
            break
        tested = pairs if tested is None else tested.union(pairs)
        links = stored(confirmed(pairs, asked, full, percent), "confirmed")
        if links.count() < WORTH * asked:
            late = links
            break
        found = joined(found, links)
        still = still_open(still, found)
    if not still.isEmpty():
        certain, pairs = peeled(still, full, percent)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = confirmed(pairs, pairs.count(), full, percent).union(certain)
        links = stored(links if late is None else links.union(late), "confirmed")
        if not links.isEmpty():
            found = joined(found, links)
    # Classes that a link or a copy ties together; all other documents stand alone.
    if found is None:
        tied = classes.withColumn("component", F.lit(None).cast(dict(classes.dtypes)["id"])).where("copies > 1")
    else:
        tied = classes.join(found, "id", "left").where("copies > 1 or component is not null")
    tied = stored(tied.select("c1", "c2", "n", F.coalesce("component", "id").alias("component")), "tied")
    out = sketch.select("id", "n", "c1", "c2").join(tied, ["c1", "c2", "n"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
