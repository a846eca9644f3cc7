"""Language-model scores by a weighted backoff automaton.

Tokens are ASCII-lower-cased words and one end token a text.  The model is an interpolation-free backoff model of
``ORDER`` words: absolute discounting where an n-gram was seen in training, else a backoff weight times the shorter
history's probability, down to add-one word probabilities; all probabilities of a history sum to one.

* Every n-gram of the training texts is an arc, whatever its count, so the model grows with the corpus.  ``Automaton`` is
  the model in memory; ``score`` gives the same values with its arcs and failure arcs dealt out by history.
* Texts are written once as chunks of some ``CHUNK`` bytes: words' numbers in the chunk, and its distinct words.  They lie in buckets by
  chunk, so that answers come to them and they aren't shuffled.
* Three rounds follow.  A chunk asks for each of its distinct words, pairs and triples once, with its own training
  counts; a task adds the counts up and answers every chunk.  Words are dealt by themselves, pairs by their first word,
  triples by their history, to tasks of some ``DEALT`` tokens, as compressed arrays.
* After the first round chunks are written anew with their words' numbers and counts; what was written before is deleted.
* Pairs and triples are asked for in ``PASSES`` passes over the tasks; a pass's questions are deleted when it is answered.
* What only one chunk holds is counted there: of such n-grams, sums a history are sent on for its failure arc.
* Pairs of a first word with more than ``HOT`` occurrences are dealt by both words; each task gives its part of the
  failure arc's sums, a row a word and task, at most (tokens / HOT) * (1 + tokens / DEALT) rows, summed to tokens / HOT
  rows, which are broadcast.
* The chunk then adds up its texts' logarithms.

Words are numbered in their round, small numbers for frequent ones; they, pairs and triples are told apart by 64-bit hashes,
but histories are asked for by their words' numbers, in order, which compress as hashes don't.  Null texts are empty: one end
token.  Repeated rows are scored each.  Without training texts N and V are 0 and every token has probability 1.  An empty table gives no
rows.  Other columns are ignored.
"""

import math
import pickle
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from positdb.llm.common import clear_work, keep_memory, map_arrow, stored, stored_by, work_tables

ORDER = 3
DISCOUNT = 0.75
#: The end token; no word holds a line feed.
END = b"\n"
#: Bytes of text a chunk, tokens a task of the rounds, occurrences from which a first word's pairs are spread.
CHUNK, DEALT, HOT = 1 << 22, 1_000_000, 500_000
#: Of the compressed arrays between rounds.
LEVEL = 3
#: Passes over the tasks that answer pairs and triples: only one pass's questions are on disk at a time.
PASSES = {"pairs": 1, "triples": 2}
#: Number of the begin; words' numbers are larger.
BEGIN = np.uint64(0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """Lengths of the texts with begin and end, their words' numbers (0 is the begin, 1 the end), how many words from number 1 on and these, parted by blanks."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    n, words = pc.list_value_length(parts).to_numpy(zero_copy_only=False), parts.flatten()
    held = pc.binary_length(words).to_numpy() > 0  # blanks at a text's ends leave empty words
    if not held.all():
        n, words = np.bincount(np.repeat(np.arange(len(n)), n)[held], minlength=len(n)), words.filter(pa.array(held))
    words = words.dictionary_encode()
    lengths = n.astype(np.int32) + 2
    ends = np.cumsum(lengths) - 1
    inner = np.ones(int(lengths.sum()), dtype=bool)
    inner[ends] = inner[ends + 1 - lengths] = False
    seq = np.zeros(len(inner), dtype=np.int32)
    seq[ends], seq[inner] = 1, words.indices.to_numpy() + 2
    known = pa.concat_arrays([pa.array([END.decode()]), words.dictionary.cast(pa.string())])
    return lengths, seq, len(known), pc.binary_join(pa.ListArray.from_arrays([0, len(known)], known), " ")[0].as_buffer().to_pybytes()


def packed(*arrays: np.ndarray) -> bytes:
    """Compressed: whole numbers (none is negative) in as few bytes as hold them, all first bytes, then all second ones, ..."""
    import zstandard

    small = [x.astype(np.min_scalar_type(x.max())) if x.dtype.kind in "iu" and len(x) else x for x in arrays]
    planes = [(x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) for x in small]
    return zstandard.ZstdCompressor(level=LEVEL).compress(pickle.dumps(planes, protocol=5))


def unpacked(data: bytes) -> list[np.ndarray]:
    """Whole numbers of up to four bytes and flags as int64, hashes as uint64."""
    import zstandard

    found = []
    for kind, planes in pickle.loads(zstandard.decompress(bytes(data))):
        kind = np.dtype(kind)
        x = np.frombuffer(planes, dtype=np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1)
        found.append(x.astype(np.int64) if kind.kind in "iu" and kind.itemsize < 8 else x)
    return found


def lists(found: list[pa.Array]) -> pa.Array:
    """A list column with the arrays as its rows."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), type=pa.int32()), pa.concat_arrays(found)) if found else pa.array([], type=pa.list_(pa.null()))


def chunks(docs: DataFrame, kind: str) -> DataFrame:
    """chunk, ids, data (lengths, training, words' numbers; training counts of words; words, parted by blanks), tokens and texts learned from."""

    def make():
        partition, made = TaskContext.get().partitionId(), 0

        def work(batch):
            nonlocal made
            out: dict[str, list] = {k: [] for k in ("chunk", "ids", "data", "tokens", "texts")}
            texts, training = batch.column("text"), np.array(batch.column("t").to_pylist(), dtype=bool)
            cuts, held = [0], 0
            for i, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
                held += n or 0
                if held >= CHUNK or i == len(texts):
                    cuts.append(i)
                    held = 0
            for a, b in zip(cuts, cuts[1:]):
                lengths, seq, kinds, words = tokens(texts.slice(a, b - a))
                counts = np.bincount(seq[np.repeat(training[a:b], lengths)], minlength=kinds + 1)[1:]
                out["chunk"].append((partition << 36) + made)
                out["ids"].append(batch.column("id").slice(a, b - a))
                out["data"].append(packed(lengths, training[a:b], seq, counts, np.frombuffer(words, dtype=np.uint8)))
                out["tokens"].append(int(counts.sum())), out["texts"].append(int(counts[0]))
                made += 1
            return out | {"ids": lists(out["ids"])}

        return work

    return map_arrow(docs, make, f"chunk long, ids array<{kind}>, data binary, tokens long, texts long")


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two codes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def of_names(*names: np.ndarray) -> np.ndarray:
    """Codes of histories of one or two words: the number, or the pair's hash."""
    return names[0] if len(names) == 1 else pair(*names)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (none is negative), ascending, a position of each and the number of every position's key.

    Keys that leave room for it are sorted with their positions below them, which is faster than sorting positions.
    """
    n, bits = len(keys), len(keys).bit_length()
    if n and keys.dtype == np.int64 and int(keys.max()) >> (63 - bits) == 0:
        found = np.sort(keys << bits | np.arange(n))
        order = found & ((1 << bits) - 1)
        found >>= bits
    else:
        order = np.argsort(keys)
        found = keys[order]
    new = np.ones(n, dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    of = np.empty(n, dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return found[new], order[new], of


def in_order(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Positions by bucket, ascending in each; numbers of two bytes are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def by_bucket(bucket: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Positions in each bucket, ascending."""
    order = in_order(bucket, buckets)
    ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
    return {b: x for b, x in enumerate(np.split(order, ends[:-1])) if len(x)}


def backoff(arcs: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """What the arcs leave of a history seen so often, over what its arcs' words leave of the shorter history."""
    left = np.maximum(1e-12, DISCOUNT * arcs / np.maximum(seen, 1)) / np.maximum(1e-12, 1 - lower)
    return np.where(arcs > 0, left, 1.0)


class Level:
    """A chunk's n-grams of one length, by history.

    Histories have ``names``, their words' numbers (one array a word), how often training ``seen`` them and ``of``, the
    divisor of their arcs' shorter probability; n-grams have the ``history``'s place, a code, the chunk's training ``count`` and
    ``num``, the shorter probability times ``of``, less ``shift``.  ``alone`` n-grams and histories need no other chunk's counts.
    Histories come by their words' numbers, the last one first, and n-grams by history and code: neighbours alike compress well.
    """

    def __init__(self, names, seen, of, history, code, count, num, shift: float, alone_history, alone, buckets: int, hot: float = math.inf) -> None:
        self.names, self.seen, self.of, self.history, self.code, self.count, self.num = names, seen, of, history, code, count, num
        codes, n = of_names(*names), len(seen)
        alone_history = alone_history | (seen == 0)
        self.alone_history, self.alone = alone_history, alone | (num == 0) | alone_history[history]
        own = np.flatnonzero(self.alone & (count > 0))
        self.arcs = np.bincount(history[own], minlength=n)
        self.nums = np.bincount(history[own], weights=num[own], minlength=n).astype(np.int64)
        self.lower = (self.nums + shift * self.arcs) / of
        self.needed = np.bincount(history[self.alone & (count == 0)], minlength=n) > 0
        # Asked are open histories and their n-grams: by bucket, each in the order above.
        asked, open_ = np.flatnonzero(~self.alone), np.flatnonzero(~alone_history)
        self.home = (codes % np.uint64(buckets)).astype(np.int64)
        key = self.home[history[asked]]
        spread = np.flatnonzero(seen[history[asked]] > hot)
        key[spread] = pair(codes[history[asked[spread]]], code[asked[spread]]) % np.uint64(buckets)
        rows, _, _ = grouped(np.concatenate([self.home[open_] * n + open_, key[spread] * n + history[asked[spread]]]))
        bucket, self.rows = np.divmod(rows, max(1, n))
        self.grams, self.place = asked[in_order(key, buckets)], np.empty(n, dtype=np.int64)
        held = np.bincount(bucket, minlength=buckets)
        self.buckets = np.flatnonzero(held).tolist()
        self.row_ends, self.gram_ends = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (held, np.bincount(key, minlength=buckets)))

    def asked(self, turn: int, turns: int):
        """(bucket, asked) of one of some turns."""
        for b in (b for b in self.buckets if b % turns == turn):
            rows, at = self.rows[self.row_ends[b] : self.row_ends[b + 1]], self.grams[self.gram_ends[b] : self.gram_ends[b + 1]]
            self.place[rows] = np.arange(len(rows))
            runs, home = np.bincount(self.place[self.history[at]], minlength=len(rows)), self.home[rows] == b
            yield b, packed(self.seen[rows], self.of[rows], runs, self.arcs[rows] * home, self.nums[rows] * home, self.needed[rows], self.code[at], self.count[at], self.num[at], *(x[rows] for x in self.names))

    def take(self, answers: dict[int, bytes]) -> None:
        """Sets all training counts as ``total``, the histories' ``weight`` (0 where no n-gram takes it) and ``alone``."""
        self.total, self.weight = self.count.copy(), np.log10(backoff(self.arcs, self.seen, self.lower))
        if self.buckets:
            found = zip(*(unpacked(answers[b]) for b in self.buckets))
            self.total[self.grams], self.alone[self.grams], self.weight[self.rows] = map(np.concatenate, found)


def answers(found: pd.DataFrame, shift: float, hot: float = math.inf) -> pd.DataFrame:
    """Answers to what levels ask, and for hot histories the sums of this task."""
    asked = [unpacked(x) for x in found["asked"]]
    row_ends, ends = np.cumsum([len(x[0]) for x in asked])[:-1], np.cumsum([len(x[6]) for x in asked])[:-1]
    seen, of, runs, arcs, nums, needed, code, count, num, *histories = (np.concatenate(x) for x in zip(*asked))
    codes, code = of_names(*(x.astype(np.uint64) for x in histories)), code.astype(np.uint64)
    names, _, at = grouped(codes)
    row = np.repeat(np.arange(len(codes)), runs)
    _, first, gram = grouped(pair(codes[row], code))
    total, alone = np.bincount(gram, weights=count).astype(np.int64)[gram], (np.bincount(gram) == 1)[gram]
    kept = first[total[first] > 0]
    lower = np.bincount(at, weights=(nums + shift * arcs) / of, minlength=len(names))
    arcs = np.bincount(at, weights=arcs, minlength=len(names)) + np.bincount(at[row[kept]], minlength=len(names))
    lower += np.bincount(at[row[kept]], weights=(num[kept] + shift) / of[row[kept]], minlength=len(names))
    often = np.zeros(len(names))
    often[at] = seen
    weight = np.log10(backoff(arcs, often, lower))[at].astype(np.float32)
    weight[~needed.astype(bool) & (np.bincount(row, weights=total == 0, minlength=len(codes)) == 0)] = 0.0
    rows = [(c, packed(*x), None, None, None) for c, *x in zip(found["chunk"], np.split(total, ends), np.split(alone, ends), np.split(weight, row_ends))]
    rows += [(None, None, int(names[i : i + 1].view(np.int64)[0]), float(arcs[i]), float(lower[i])) for i in np.flatnonzero(often > hot)]
    # As objects first: codes have more digits than a float.
    out = pd.DataFrame(rows, columns=["chunk", "answer", "word", "arcs", "lower"], dtype=object)
    return out.astype({"chunk": "Int64", "word": "Int64", "arcs": float, "lower": float}).assign(bucket=int(found["bucket"].iloc[0]))


def answers_of_words(found: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Training counts of words, whether only one chunk has them, and else their numbers, small ones for frequent words.

    ``word`` is how many words were learned.
    """
    asked = [unpacked(x) for x in found["asked"]]
    codes, counts = (np.concatenate(x) for x in zip(*asked))
    names, _, of = grouped(codes.astype(np.uint64))
    total, alone, ends = np.bincount(of, weights=counts).astype(np.int64), np.bincount(of) == 1, np.cumsum([len(x[0]) for x in asked])[:-1]
    number = np.empty(len(names), dtype=np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(1, len(names) + 1)
    number = np.where(alone, 0, number * buckets + int(found["bucket"].iloc[0]))
    rows = [(c, packed(*x), None) for c, *x in zip(found["chunk"], np.split(total[of], ends), np.split(alone[of], ends), np.split(number[of], ends))]
    out = pd.DataFrame([*rows, (None, None, int((total > 0).sum()))], columns=["chunk", "answer", "word"], dtype=object)
    return out.astype({"chunk": "Int64", "word": "Int64"}).assign(bucket=int(found["bucket"].iloc[0]), arcs=0.0, lower=0.0)


def hashes(words: np.ndarray) -> np.ndarray:
    """Of ``chunks``' words, which hold no blank."""
    return pd.util.hash_array(np.array(words.astype(np.uint8).tobytes().split(b" "), dtype=object), categorize=False)


def words_asked(data: bytes, buckets: int) -> list[tuple[int, bytes]]:
    """What ``chunks``' data asks of each bucket: hashes and training counts of words."""
    *_, counts, words = unpacked(data)
    codes = hashes(words)
    return [(b, packed(codes[at], counts[at])) for b, at in by_bucket(codes % np.uint64(buckets), buckets).items()]


def numbered(data: bytes, given: dict[int, bytes], buckets: int) -> bytes:
    """``chunks``' data with the answers by bucket in place of counts and words: all training counts, alone, numbers.

    The chunk's words are numbered anew, in the order of their numbers.
    """
    lengths, training, seq, _, words = unpacked(data)
    codes = hashes(words)
    found = [np.zeros(len(codes), dtype=kind) for kind in (np.int64, bool, np.int64)]
    for b, at in by_bucket(codes % np.uint64(buckets), buckets).items():
        for x, answer in zip(found, unpacked(given[b])):
            x[at] = answer
    order, place = np.argsort(found[2], kind="stable"), np.zeros(len(codes) + 1, dtype=np.int64)
    place[order + 1] = np.arange(1, len(place))
    return packed(lengths, training, place[seq], *(x[order] for x in found))


class Chunk:
    """Texts of a numbered chunk, and what the rounds of pairs and triples answered: ``given`` has it by round and bucket."""

    def __init__(self, data: bytes, model: tuple, given: list[dict[int, bytes]], spread: dict) -> None:
        begins, self.divisor, buckets, hot = model
        self.lengths, training, self.seq, *found = unpacked(data)
        self.c1, alone, self.codes = (np.concatenate([[first], x]) for first, x in zip((begins, False, BEGIN), found))
        alone, self.codes = alone.astype(bool), self.codes.astype(np.uint64)
        n, self.text = len(self.codes), np.repeat(np.arange(len(self.lengths)), self.lengths)
        learned = training[self.text].astype(float)
        second = np.flatnonzero(self.seq) - 1  # positions of a pair's first word
        key, _, self.pair_of = grouped(self.seq[second] * n + self.seq[second + 1])
        h, w = np.divmod(key, n)
        count = np.bincount(self.pair_of, weights=learned[second], minlength=len(key)).astype(np.int64)
        self.pairs = Level((self.codes,), self.c1, np.full(n, self.divisor), h, self.codes[w], count, self.c1[w], 1.0, alone, alone[h] | alone[w], buckets, hot)
        # A word that was not learned still has the root's probability; its pairs were not seen.
        starts = np.flatnonzero(self.seq[second] == 0)
        self.first_pairs, self.first_texts, self.w = self.pair_of[starts], self.text[second[starts]], w
        if not given:
            return
        self.pairs.take(given[0])
        common = np.flatnonzero((self.c1 > hot) & ~self.pairs.alone_history)
        sums = np.array([spread.get(c, (0.0, 0.0)) for c in self.codes[common].view(np.int64).tolist()]).reshape(-1, 2)
        self.pairs.weight[common] = np.log10(backoff(sums[:, 0], self.c1[common], sums[:, 1]))
        inner = np.flatnonzero(self.seq[second] != 0)  # places in ``second`` whose pair ends a triple
        _, order, place = grouped(w * n + h)
        key, first, self.triple_of = grouped(place[self.pair_of[inner - 1]] * n + self.seq[second[inner] + 1])
        (history, last), self.suffix = np.divmod(key, n), self.pair_of[inner[first]]
        count = np.bincount(self.triple_of, weights=learned[second[inner]], minlength=len(key)).astype(np.int64)
        total, alone, h, w = self.pairs.total, self.pairs.alone, h[order], w[order]
        self.triples = Level((self.codes[h], self.codes[w]), total[order], np.maximum(self.c1[w], 1), history, self.codes[last], count, total[self.suffix], -DISCOUNT, alone[order], alone[order][history] | alone[self.suffix], buckets)
        self.triple_texts = self.text[second[inner]]
        if len(given) > 1:
            self.triples.take(given[1])

    def results(self) -> dict[str, np.ndarray]:
        root = np.log10((self.c1 + 1.0) / self.divisor)

        def logs(level: Level, shorter: np.ndarray) -> np.ndarray:
            arc = np.log10(np.maximum(level.total - DISCOUNT, 1e-9) / np.maximum(level.seen[level.history], 1))
            return np.where(level.total > 0, arc, level.weight[level.history] + shorter)

        of_pair = logs(self.pairs, root[self.w])
        of_triple = logs(self.triples, of_pair[self.suffix])
        tokens = self.seq != 0

        def add(at, values):
            return np.bincount(at, weights=values, minlength=len(self.lengths))

        return {
            "n_tokens": self.lengths - 1,
            "n_known": add(self.text[tokens], self.c1[self.seq[tokens]] > 0).astype(np.int64),
            "base": add(self.text[tokens], root[self.seq[tokens]]),
            "score": add(self.triple_texts, of_triple[self.triple_of]) + add(self.first_texts, of_pair[self.first_pairs]),
        }


class Automaton:
    """States are histories; ``arcs[s][w]`` is (logarithm, next state), ``weight`` and ``fail`` belong to failure arcs."""

    def __init__(self, counts: np.ndarray, begins: int, total: int, kinds: int, grams: list[list[tuple[int, int]]]) -> None:
        base = len(counts) + 1
        self.begin_id = base - 1
        self.log_all = math.log10(total + kinds + 1)
        unigram = (counts + 1.0) / (total + kinds + 1)
        self.root = np.log10(unigram).tolist()
        times = {(w,): float(c) for w, c in enumerate(counts)} | {(base - 1,): float(begins)}
        prob: dict[tuple[int, ...], float] = {(w,): float(p) for w, p in enumerate(unigram)}
        after: dict[tuple[int, ...], list[int]] = {}
        for n, order in enumerate(grams, 2):
            for key, c in order:
                gram = tuple(key // base ** (n - 1 - i) % base for i in range(n))
                times[gram] = float(c)
                prob[gram] = (c - DISCOUNT) / times[gram[:-1]]
                after.setdefault(gram[:-1], []).append(gram[-1])
        state = {h: i for i, h in enumerate(sorted(after, key=lambda h: (len(h), h)), 1)}
        self.fail, self.weight, self.arcs = [0] * (len(state) + 1), [0.0] * (len(state) + 1), [{} for _ in range(len(state) + 1)]

        def longest(h: tuple[int, ...]) -> int:
            while h and h not in state:
                h = h[1:]
            return state[h] if h else 0

        self.backoff: dict[tuple[int, ...], float] = {}

        def smooth(h: tuple[int, ...], w: int) -> float:
            if h + (w,) in prob:
                return prob[h + (w,)]
            return self.backoff.get(h, 1.0) * smooth(h[1:], w)

        for h in sorted(after, key=len):
            kept = sum(prob[h + (w,)] for w in after[h])
            lower = sum(smooth(h[1:], w) for w in after[h])
            self.backoff[h] = max(1e-12, 1 - kept) / max(1e-12, 1 - lower)
            s = state[h]
            self.fail[s], self.weight[s] = longest(h[1:]), math.log10(self.backoff[h])
            for w in after[h]:
                self.arcs[s][w] = (math.log10(prob[h + (w,)]), longest((h + (w,))[-(ORDER - 1) :]))
        self.start = longest((base - 1,))
        self.after_root = [longest((w,)) for w in range(base)]

    def traverse(self, ids: list[int]) -> float:
        """Logarithm of the tokens' probability; a token without id counts as its failure arcs and the root's divisor."""
        arcs, fail, weight, root, after_root = self.arcs, self.fail, self.weight, self.root, self.after_root
        s, total = self.start, 0.0
        for w in ids:
            while s:
                arc = arcs[s].get(w)
                if arc is not None:
                    total += arc[0]
                    s = arc[1]
                    break
                total += weight[s]
                s = fail[s]
            else:
                if w >= 0:
                    total += root[w]
                    s = after_root[w]
                else:
                    total -= self.log_all
        return total


def written_once(df: DataFrame, write, *how: str) -> DataFrame:
    """``stored`` or ``stored_by``, with the shuffle files of the write deleted at its end: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return write(df, *how)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", dealt: int = DEALT, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows where ``training`` (over ``id``) holds.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("t", F.coalesce(training, F.lit(False)))
    kind = slim.schema["id"].dataType.simpleString()
    since = work_tables()
    written = stored_by(chunks(slim, kind), "chunk", "chunks")
    sums = written.agg(F.sum("tokens").alias("n"), F.sum("texts").alias("ends")).first()
    total, begins = int(sums.n or 0), int(sums.ends or 0)
    buckets, divisor, spread = max(1, math.ceil(total / dealt)), 1, {}
    tables: list[DataFrame] = []
    question = "bucket long, chunk long, asked binary"
    reply = "bucket long, chunk long, answer binary, word long, arcs double, lower double"

    def given(*columns: str) -> DataFrame:
        """Chunks with the answers so far."""
        out = written.select("chunk", "data", *columns)
        for k, t in enumerate(tables):
            found = t.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(f"given{k}"))
            out = out.join(found, "chunk", "left")
        return out

    def mapped(make_rows, *columns: str, schema: str) -> DataFrame:
        """What is made of each chunk: of its batch, data and answers."""
        done = len(tables)

        def make():
            keep_memory()
            return work

        def work(batch):
            answers = [{r["bucket"]: r["answer"] for r in batch.column(f"given{k}")[0].as_py() or []} for k in range(done)]
            return make_rows(batch, batch.column("data")[0].as_py(), answers)

        return map_arrow(given(*columns), make, schema, most=1)

    def of_chunk(make_rows):
        model, known = (begins, divisor, buckets, hot), docs.sparkSession.sparkContext.broadcast(spread)
        return lambda batch, data, answers: make_rows(batch, Chunk(data, model, answers, known.value))

    def questions(batch, found) -> dict:
        found = list(found)
        return {"bucket": [b for b, _ in found], "chunk": batch.column("chunk").to_pylist() * len(found), "asked": [a for _, a in found]}

    asked = mapped(lambda batch, data, _: questions(batch, words_asked(data, buckets)), schema=question)
    tables.append(written_once(asked.groupBy("bucket").applyInPandas(lambda rows: answers_of_words(rows, buckets), reply), stored, "words"))
    divisor = total + int(tables[0].agg(F.sum("word").alias("v")).first().v or 0) + 1
    again = mapped(lambda batch, data, found: {k: batch.column(k) for k in ("chunk", "ids")} | {"data": [numbered(data, found[0], buckets)]}, "ids", schema=f"chunk long, ids array<{kind}>, data binary")
    until = work_tables()
    written, tables = written_once(again, stored_by, "chunk", "numbered"), []
    clear_work(docs.sparkSession, since, until=until)
    def answered(level: str, answer) -> DataFrame:
        """The answers to all chunks' questions of a level."""
        found, turns = [], min(PASSES[level], buckets)
        for turn in range(turns):
            asked = mapped(of_chunk(lambda batch, x, turn=turn: questions(batch, getattr(x, level).asked(turn, turns))), schema=question)
            found.append(written_once(asked.groupBy("bucket").applyInPandas(answer, reply), stored, level))
        return reduce(DataFrame.unionByName, found)

    tables.append(answered("pairs", lambda rows: answers(rows, 1.0, hot)))
    parts = tables[0].where("word is not null").groupBy("word").agg(F.sum("arcs").alias("arcs"), F.sum("lower").alias("lower"))
    spread = {r.word: (r.arcs, r.lower) for r in parts.collect()}
    tables.append(answered("triples", lambda rows: answers(rows, -DISCOUNT)))
    scored = mapped(of_chunk(lambda batch, x: x.results() | {"id": batch.column("ids").flatten()}), "ids", schema=f"id {kind}, n_tokens long, n_known long, base double, score double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
