"""Quality classification from weak labels.

* Labellers: heuristics over the whole text, each of which votes good, bad or abstains (``votes``).
* Label model: expectation-maximisation over the counts of vote patterns.  Given the unknown class the labellers vote
  independently, each with its own accuracy on good and on bad ones, abstaining apart; the class prior is estimated too, and the majority of votes starts
  it, which fixes which class is good.  Patterns are counted over all documents and are at most 3 to the number of
  labellers, whatever the input.
* Scorer: a logistic model over hashed words, word shapes and repetitions (relative frequencies in the text), fitted to the
  posterior of ``SAMPLE`` documents at most (expected; drawn by a hash of id and text).  All documents are scored by it.
* A document is kept unless the scorer and the label model agree that it is bad (both below ``CUT``).

Null texts are empty; a text without words gets the score of no features and the posterior of its votes.  Repeated
rows are repeated; an empty table gives no rows.  Other columns are ignored.
"""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from positdb.llm.common import map_arrow, utf8

SAMPLE = 4000
BITS = 16
CUT = 0.5
REMEMBERED = 300_000

LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and c < 128 or c >= 128)
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SPACES = b" \t\n\r\x0b\x0c"

LABELLERS = ("length", "word_length", "letters", "marks", "upper", "digits", "repeated_words", "repeated_lines", "variety", "stutter")


def band(value: float, good: bool, bad: bool) -> int:
    """1 good, 0 bad, 2 abstains."""
    return 1 if good else 0 if bad else 2


def votes(text: bytes) -> int:
    """The votes of all labellers as one number in base 3; bytes beyond ASCII count as letters."""
    words = text.split()
    n = len(words)
    if not n:
        return sum(2 * 3**i for i in range(1, len(LABELLERS)))  # the length is bad, all others abstain
    solid = len(text.translate(None, SPACES))
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / solid
    letters, upper, digits = share(LETTERS), share(UPPER), share(DIGITS)
    mean = solid / n
    bare = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128) / n  # words that end in a mark
    count = Counter(words)
    top = count.most_common(1)[0][1] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    variety = len(count) / n
    stutter = sum(map(bytes.__eq__, words, words[1:])) / n  # words that repeat the one before
    found = (
        band(n, n >= 40, n < 3),
        band(mean, 3.5 <= mean <= 10, mean < 2.5 or mean > 14),
        band(letters, letters >= 0.9, letters < 0.8),
        band(bare, bare <= 0.25, bare > 0.5),
        band(upper, upper <= 0.08, upper > 0.3),
        band(digits, digits <= 0.1, digits > 0.3),
        band(top, top <= 0.1 and n >= 40, top > 0.2 and n >= 20),
        band(again, again <= 0.05, again > 0.3),
        band(variety, variety >= 0.35, variety < 0.2 and n >= 40),
        band(stutter, stutter <= 0.05, stutter > 0.2),
    )
    return sum(v * 3**i for i, v in enumerate(found))


def digits_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


def label_model(patterns: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior probability of good for each vote pattern."""
    if not patterns:
        return {}
    codes = np.array(sorted(patterns), dtype=np.int64)
    weight = np.array([patterns[c] for c in codes], dtype=float)
    v = digits_of(codes)
    good = ((v == 1).sum(axis=1) + 0.5) / ((v == 1).sum(axis=1) + 2 * (v == 0).sum(axis=1) + 1.0)  # a bad vote weighs two
    for _ in range(rounds):
        prior = ((weight * good).sum() + 1) / (weight.sum() + 2)
        logs = np.log([[1 - prior], [prior]]) * np.ones((2, len(codes)))
        for j in range(len(LABELLERS)):
            for y, p in enumerate((1 - good, good)):
                table = np.array([(weight * p)[v[:, j] == k].sum() for k in range(2)]) + 1.0
                logs[y] += np.append(np.log(table / table.sum()), 0.0)[v[:, j]]  # abstaining says nothing
        logs -= logs.max(axis=0)
        new = np.exp(logs[1]) / np.exp(logs).sum(axis=0)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(codes.tolist(), good.tolist()))


class Cells(dict):
    """The hashed cells of a word: the lower-cased word and its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        kind = b"U" if word.isupper() else b"a" if word.islower() else b"T" if word[:1].isupper() else b"x"
        end = word[-1:] if not word[-1:].isalnum() and word[-1] < 128 else b"a"
        shape = b"\0" + kind + end + bytes([min(len(word), 16)])
        mask = (1 << BITS) - 1
        found = self[word] = (zlib.crc32(word.lower()) & mask, zlib.crc32(shape) & mask)
        return found


def tokens(text: bytes) -> list[bytes]:
    """The words, and a token of its own for each that repeats the one before."""
    words = text.split()
    return words + [b"\1"] * sum(map(bytes.__eq__, words, words[1:]))


def hashed(text: bytes, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their relative frequencies."""
    count: Counter = Counter()
    for w, n in Counter(tokens(text)).items():
        for c in cells[w]:
            count[c] += n
    total = sum(count.values()) or 1
    return np.fromiter(count.keys(), dtype=np.int64, count=len(count)), np.fromiter(count.values(), dtype=float, count=len(count)) / total


def fit(texts: list[bytes], goals: list[float], epochs: int = 12, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps in a fixed order."""
    cells = Cells()
    rows = [hashed(t, cells) for t in texts]
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at, x = rows[i]
            z = float(w[at] @ x) + bias
            d = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - goals[i]
            g = d * x + 1e-6 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            b2 += d * d
            bias -= 0.1 * d / math.sqrt(b2)
    return w, bias


class Weights(dict):
    """Summed weight of a word's cells, remembered."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.cells = weights, Cells()

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        a, b = self.cells.__missing__(word)
        self.cells.clear()
        w = self[word] = float(self.weights[a] + self.weights[b]) / 2
        return w


def quality(docs: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, label_prob (posterior of the label model), score, kept."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def vote():
        return lambda batch: {"pattern": [votes(t) for t in utf8(batch, "text")]}

    counted = map_arrow(slim.select("text"), vote, "pattern long").groupBy("pattern").count().collect()  # 3 ** labellers rows at most
    patterns = {r["pattern"]: r["count"] for r in counted}
    posterior, total = label_model(patterns), sum(patterns.values())
    cells = 1 << 40
    drawn = slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(cells)) < min(cells, cells * most // max(1, total))).select("text").collect()
    texts = sorted((r.text or "").encode() for r in drawn)
    model = spark.sparkContext.broadcast((posterior, *fit(texts, [posterior[votes(t)] for t in texts])))

    def score():
        posterior, w, bias = model.value
        weights = Weights(w)

        def work(batch):
            texts = utf8(batch, "text")
            label = [posterior[votes(t)] for t in texts]
            z = [sum(map(weights.__getitem__, s)) / (len(s) or 1) + bias for s in map(tokens, texts)]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]
            return {"id": batch.column("id"), "label_prob": label, "score": p, "kept": [a >= CUT or b >= CUT for a, b in zip(label, p)]}

        return work

    return map_arrow(slim, score, f"id {kind}, label_prob double, score double, kept boolean").withColumnRenamed("id", id_col)
