"""Nearest neighbours by largest inner product with a hash-prefix forest.

* Every tree hashes a vector's direction to a long string of ``BITS`` signs of random projections and keeps the strings of
  its vectors as a sorted array.  The trees draw their projections from a pool of ``PLANES``, the first ones disjoint.
* A query descends by binary search to the vectors that share the longest prefix with it, whatever its length, in every
  tree; then all trees ascend together, one bit at a time, until the prefix ranges of all trees hold ``GATHERED`` entries
  for every vector of the block, counted with repeats.
* The share of trees in whose range a vector lies estimates its angle: at depth d it is (1 - angle / pi) ** d.  With its
  norm that estimates the inner product.  The ``CANDIDATES`` vectors of the largest estimates, and all that tie with the
  last, are checked with exact inner products, summed in the order of the components.
* Rows are dealt to blocks of some ``BLOCK`` vectors, each with a forest of its own, and queries to chunks; a task
  takes one block and one chunk, so its memory is bounded at every size.  A query keeps its ``k`` best of each block,
  and of these its ``k`` best.

A block with no more vectors than candidates is checked wholly.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without id.
Vectors of different dimensions are never compared.  Rows with a query's own id are not its candidates; other repeated
rows count each.  Rows that share a query's id share its ranks.  With fewer candidates than ``k`` all are returned; without
any, the query has no rows.  An empty table gives no rows.  Other columns are ignored.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from positdb.llm.common import stored

TREES, BITS, PLANES = 256, 24, 1024
BLOCK, CHUNK = 8192, 16_384
#: Entries, for each vector of a block, at which the trees stop to ascend, and vectors that are then checked.
GATHERED, CANDIDATES = 6, 600
#: Queries whose ranges are held at once.
TOGETHER = 256


@lru_cache(maxsize=4)
def projections(dimension: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([31, dimension])).standard_normal((dimension, PLANES)).astype(np.float32)


@lru_cache(maxsize=1)
def planes_of_trees() -> np.ndarray:
    """Trees x bits: numbers of planes.  Read bit by bit they run through permutations of the pool."""
    draw = np.random.Generator(np.random.PCG64(37))
    found = np.concatenate([draw.permutation(PLANES) for _ in range(-(-TREES * BITS // PLANES))])
    return found[: TREES * BITS].reshape(BITS, TREES).T


def keys(vectors: np.ndarray) -> np.ndarray:
    """Hash strings, first sign highest: trees x vectors."""
    out = np.empty((TREES, len(vectors)), dtype=np.int32)
    at = planes_of_trees()
    for i in range(0, len(vectors), 1024):
        signs = (vectors[i : i + 1024].astype(np.float32) @ projections(vectors.shape[1]) > 0).T.astype(np.int32)
        part = np.zeros((TREES, signs.shape[1]), dtype=np.int32)
        for bit in range(BITS):
            part = part << 1 | signs[at[:, bit]]
        out[:, i : i + 1024] = part
    return out


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        found = keys(vectors)
        self.order = np.argsort(found, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(found, self.order, axis=1)

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows that share the first ``depth`` bits with each query begin and end: trees x queries."""
        shift = (BITS - depth).astype(np.int32)
        low = strings >> shift << shift
        high = low + (np.int32(1) << shift)
        left, right = np.empty(low.shape, dtype=np.int32), np.empty(low.shape, dtype=np.int32)
        for t in range(TREES):
            left[t], right[t] = np.searchsorted(self.sorted[t], low[t]), np.searchsorted(self.sorted[t], high[t])
        return left, right

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Row numbers, ascending, for each query in turn."""
        n = len(self.norms)
        if n <= enough:
            yield from (np.arange(n) for _ in queries)
            return
        for first in range(0, len(queries), TOGETHER):
            strings = keys(queries[first : first + TOGETHER])
            # All trees of a query ascend together; the depth at which they stop is found by bisection.
            few, depth = np.full(strings.shape[1], BITS + 1), np.zeros(strings.shape[1], dtype=int)
            while (few - depth > 1).any():
                middle = (few + depth) // 2
                left, right = self.ranges(strings, middle)
                reached = (right - left).sum(axis=0, dtype=np.int64) >= GATHERED * n
                few, depth = np.where(reached, few, middle), np.where(reached, middle, depth)
            left, right = self.ranges(strings, depth)
            for k, d in enumerate(depth.tolist()):
                entries = np.concatenate([rows[a:b] for rows, a, b in zip(self.order, left[:, k].tolist(), right[:, k].tolist())])
                cosine = np.cos(np.pi * (1 - (np.arange(TREES + 1) / TREES) ** (1 / max(1, d))))
                estimate = self.norms * cosine[np.bincount(entries, minlength=n)]
                yield np.flatnonzero(estimate >= np.partition(estimate, n - enough)[n - enough])


def best_of_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, candidates: int) -> pd.DataFrame:
    rows = []
    for q, q_id, at in zip(queries, query_ids, Forest(vectors).candidates(queries, candidates)):
        at = at[ids[at] != q_id]
        if not len(at):
            continue
        rough = vectors[at] @ q
        if len(at) > k:
            edge = np.partition(rough, len(at) - k)[len(at) - k]
            at = at[rough >= edge - 1e-9 * (1 + abs(edge))]
        score = np.zeros(len(at))
        for j in range(len(q)):
            score += vectors[at, j] * q[j]
        first = np.lexsort((ids[at], -score))[:k]
        rows.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[at][first], "score": score[first]}))
    return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(vectors: DataFrame, queries: Column, k: int = 20, block: int = BLOCK, chunk: int = CHUNK, candidates: int = CANDIDATES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``queries`` (over ``id``) holds, its ``k`` nearest found."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    rows = rows.where("id is not null and v is not null and size(v) > 0").where(finite).withColumn("dim", F.size("v"))
    rows = stored(rows.withColumn("is_query", F.coalesce(queries, F.lit(False))), "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, chunks = max(1, math.ceil(counts.n / block)), max(1, math.ceil(counts.q / chunk))
    dealt = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = rows.where("is_query").select("id", "v", "dim", F.pmod(F.xxhash64(F.lit(7), "id", "v"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))

    def search(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if here.empty or there.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own, asking = np.stack(here["v"].to_numpy()), np.stack(there["v"].to_numpy())
        return best_of_block(own, here["id"].to_numpy(), asking, there["id"].to_numpy(), k, candidates)

    key = ["dim", "block", "chunk"]
    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
