"""Packing of tokenised documents into sequences of a fixed capacity by a configuration linear program.

1. Tokenise every text (its distinct parts between blanks, many texts' at once), add the end id, cut what is longer than the capacity; the pieces are written to the shared
   folder (they are small: no token ids, only their checksum).
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver.
3. ``plan`` solves the configuration program over it (a configuration is a multiset of lengths that fits).  Every length
   has a weight, which falls by a factor for each part of its pieces that is covered.  A knapsack dynamic program finds
   the configuration of the highest price, it is taken as often, in fractions, as its scarcest length allows, and so on
   until all pieces are covered.  The fractional solution is rounded down, never beyond what is left, and what rounding
   leaves is a smaller program of the same kind.  Every sequence comes from a rounded configuration.
4. The plan is a list of runs "pieces of this length with ranks s..e sit in sequences from b on": at most some
   thousand rows, as each configuration uses up a length.  Every piece finds its
   place from its rank among the pieces of its length, which is dealt by (length, bucket) so that a hot length
   spreads over ``BUCKETS`` tasks.

Null texts are empty: one end id.  Repeated rows are packed as often as they occur.  An empty table gives no rows.
Other columns of the input are ignored.
"""

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from positdb.llm.common import map_arrow, stored

#: A weight falls by the factor exp(-FALL) while all its length's pieces are covered; a piece that fills a sequence is
#: worth 1 + LONG times its length, as short ones are easier to place later.
FALL, LONG = 0.5, 0.3
#: Lengths that are priced first: half of them those of the highest weight.  All are where these don't fill a sequence.
PRICED = 192
#: Groups that the pieces of one length are dealt to when they are ranked.
BUCKETS = 1024
#: Remembered chunks of a worker; beyond that it starts anew.
REMEMBERED = 200_000
#: Bytes of text whose parts between blanks are numbered at once, and of the longest part that is merged with others.
AT_ONCE, LONGEST = 1 << 23, 1000

#: Unicode's White_Space, as the tokeniser's pattern sees it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs in which the pre-tokeniser's pattern never joins anything across: an optional blank and what is not white
#: space, or white space up to the last of a run, or white space.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: For Arrow: parts between blanks that are empty or have white space at an end, so that a blank beside them may not begin a chunk; letters beyond the Latin blocks.
JOINED, OTHER = r"\A\z|\A[{0}]|[{0}]\z".format(re.sub(r"\\u(\w{4})", r"\\x{\1}", SPACE)), r"[^\x00-\x{24f}]"


class ChunkIds(dict):
    """Little-endian unsigned 32-bit ids of a chunk, remembered.

    ``ranks_path`` may name the same vocabulary as ranks; its merges are then used for chunks of the Latin blocks,
    where they give the same ids faster.  All other chunks, and texts with special strings, go to the tokeniser.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.fast = Tokenizer.from_file(tokenizer_path), None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if self.fast is None or max(chunk) >= "\u0250":
            ids = self.encode(chunk)
        else:
            ids = np.array(self.fast(chunk), dtype="<u4").tobytes()
        self[chunk] = ids
        return ids

    def merged(self, parts: pa.Array, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of parts with a blank before each, of so many bytes, by one call, and how many ids each has."""
        text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts.cast(pa.string())), " ")[0].as_py()
        ids = np.array(self.fast(text), dtype="<u4")
        id_ends, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)
        last = np.searchsorted(id_ends, ends)
        if (id_ends[last] != ends).any():
            raise ValueError("a token reaches across a blank")
        return ids.tobytes(), np.diff(last, prepend=-1)

    def of(self, text: str) -> bytes:
        """The ids of a whole text; special strings change where the library cuts, so it gets such texts whole."""
        if any(s in text for s in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def ids_of_texts(known: ChunkIds, texts: pa.Array) -> list[bytes]:
    """The ids of whole texts, none of them null.

    Texts are cut at blanks.  A part without white space at its ends is made of chunks that don't depend on its neighbours,
    so each distinct one is merged once, all of them in one call.  Texts with other parts are given to ``known`` whole.
    """
    split = pc.split_pattern(texts, pattern=" ")
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts = split.flatten().dictionary_encode()
    names, at = parts.dictionary, parts.indices.to_numpy().astype(np.int64)
    k, bytes_of = len(names), pc.binary_length(names).to_numpy()
    at[np.concatenate([[0], ends[:-1]])] += k  # numbers from k on are parts that begin a text, without a blank before them
    used = np.bincount(at, minlength=2 * k) > 0
    apart = ~pc.match_substring_regex(names, pattern=JOINED).to_numpy(zero_copy_only=False)
    alike = apart & (bytes_of <= LONGEST) & ~pc.match_substring_regex(names, pattern=OTHER).to_numpy(zero_copy_only=False) & (known.fast is not None)
    merged, alone = np.flatnonzero(used[:k] & alike), np.flatnonzero(used & np.concatenate([apart & ~alike, apart | (bytes_of == 0)]))
    sizes, starts = np.zeros(2 * k, dtype=np.int64), np.zeros(2 * k, dtype=np.int64)
    pool = []
    if len(merged):
        ids, sizes[merged] = known.merged(names.take(pa.array(merged)), bytes_of[merged] + 1)
        pool.append(ids)
    for i, name in zip(alone.tolist(), names.take(pa.array(alone % max(1, k))).to_pylist()):
        pool.append(b"".join(map(known.__getitem__, CHUNK.findall(name if i >= k else " " + name))))
        sizes[i] = len(pool[-1]) // 4
    placed = np.concatenate([merged, alone])
    starts[placed] = np.cumsum(sizes[placed]) - sizes[placed]
    n = sizes[at]
    id_ends = np.cumsum(n)
    ids = np.frombuffer(b"".join(pool), dtype="<u4")[np.repeat(starts[at] - (id_ends - n), n) + np.arange(n.sum())].tobytes()
    settled = np.zeros(2 * k, dtype=bool)
    settled[placed] = True
    whole = np.zeros(len(texts), dtype=bool)
    whole[np.searchsorted(ends, np.flatnonzero(~settled[at]), side="right")] = True
    for special in known.special:
        whole |= pc.match_substring(texts, pattern=special).to_numpy(zero_copy_only=False)
    cuts = [0, *(4 * id_ends[ends - 1]).tolist()]
    return [known.of(texts[i].as_py()) if w else ids[a:b] for i, (w, a, b) in enumerate(zip(whole.tolist(), cuts, cuts[1:]))]


def all_ids(known: ChunkIds, texts: pa.Array):
    """The ids of each of a batch's texts; null counts as empty."""
    texts = texts.fill_null("")
    group = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield from ids_of_texts(known, texts.slice(a, b - a))


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece; only the first of a longer document may be shorter."""
    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = slim.schema["id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        known = ChunkIds(tokenizer_path, ranks_path)

        def work(batch):
            rows, piece, starts, lengths, crcs = [], [], [], [], []
            for i, found in enumerate(all_ids(known, batch.column("text"))):
                ids = found + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(i), piece.append(k), starts.append(a), lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[4 * a : 4 * b]))
            return {"id": batch.column("id").take(np.array(rows, dtype=np.int64)), "piece": piece, "start": starts, "length": lengths, "ids_crc32": crcs}

        return work

    return map_arrow(slim, make, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Bounded knapsack dynamic program: the multiset of lengths, at most ``most`` of each, with the highest sum of prices.

    A number of pieces of one length is a sum of powers of two and a rest, each of which is taken or not.
    """
    items = []
    for j, (x, m) in enumerate(zip(lengths.tolist(), most.tolist())):
        m, k = min(m, capacity // x), 1
        while m > 0:
            items.append((j, min(k, m), min(k, m) * x))
            m, k = m - k, 2 * k
    best, room = np.zeros(capacity + 1), np.empty(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for i, (j, k, size) in enumerate(items):
        value = np.add(best[: capacity + 1 - size], k * prices[j], out=room[: capacity + 1 - size])
        np.greater(value, best[size:], out=taken[i, size:])
        np.maximum(best[size:], value, out=best[size:])
    out: dict[int, int] = {}
    w = capacity
    for i in range(len(items) - 1, -1, -1):
        if taken[i, w]:
            j, k, size = items[i]
            out[j] = out.get(j, 0) + k
            w -= size
    return out


def fractional(left: dict[int, int], capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """How often each configuration ((length, times), ...) is taken so that all pieces are covered."""
    lengths = np.array(sorted(left), dtype=np.int64)
    counts = np.array([left[x] for x in lengths.tolist()], dtype=float)
    part, rest, weights = lengths / capacity, counts.copy(), np.ones(len(lengths))
    out: dict[tuple[tuple[int, int], ...], float] = {}
    while len(live := np.flatnonzero(rest >= 1)):
        price = weights * part * (1 + LONG * part)
        dear = live[np.argsort(-(price / part)[live], kind="stable")[: PRICED // 2]]
        some = np.union1d(dear, live[np.linspace(0, len(live) - 1, PRICED // 2).astype(np.int64)])
        for at in (some, live):
            found = best_configuration(lengths[at], price[at], rest[at].astype(np.int64), capacity)
            if len(at) == len(live) or sum(int(lengths[at[j]]) * m for j, m in found.items()) == capacity:
                break
        j, times = at[sorted(found)], np.array([found[k] for k in sorted(found)])
        step = float((rest[j] / times).min())
        key = tuple(zip(lengths[j].tolist(), times.tolist()))
        out[key] = out.get(key, 0.0) + step
        rest[j] -= step * times
        weights[j] *= np.exp(-FALL * step * times / counts[j])
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: times} with the number of sequences that use each; together they hold all pieces."""
    left = {int(x): int(n) for x, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if left.get(capacity):
        out.append(({capacity: 1}, left.pop(capacity)))
    while left:
        # Every configuration is taken once at least, so every round places some.
        for key, amount in sorted(fractional(left, capacity).items(), key=lambda x: (-x[1], x[0])):
            n = min([int(amount + 1e-9), *(left[x] // m for x, m in key)])
            if n > 0:
                out.append((dict(key), n))
                for x, m in key:
                    left[x] -= n * m
        left = {x: n for x, n in left.items() if n}
    return out


def runs(configurations: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For every length, where its pieces of which ranks go: arrays sorted by (length, first rank)."""
    rows, used, base = [], {}, 0
    for found, n in configurations:
        at = 0
        for x, m in sorted(found.items(), reverse=True):
            rows.append((x, used.get(x, 0), base, m, at))
            used[x] = used.get(x, 0) + n * m
            at += x * m
        base += n
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("length", "rank", "base", "times", "at"))}


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, ranks_path, capacity, end_id, id_col, text_col), "pieces")
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(BUCKETS)))
    groups = stored(cut.groupBy("length", "bucket").count(), "lengths")
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(runs(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1).join(groups, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = places.value
        x, r = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(p["length"] * (1 << 40) + p["rank"], x * (1 << 40) + r, side="right") - 1
        j = r - p["rank"][i]
        return pd.DataFrame({"sequence_id": p["base"][i] + j // p["times"][i], "offset": p["at"][i] + j % p["times"][i] * x})

    placed = ranked.withColumn("place", place("length", F.col("rank") + F.col("before")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
