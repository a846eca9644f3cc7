"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries, trained on toxic
and on ordinary text, and the lengths are compared.

* Learning, on the driver, from a bounded sample: some ``SAMPLE`` documents labelled toxic and ``ORDINARY`` others, of some
  ``SAMPLE_BYTES`` a label at most, drawn by a hash of the id.  Two thirds train dictionaries, one third calibrates.
* Three dictionaries are trained.  Two of ``DICTIONARY`` bytes, one on the toxic and one on as many ordinary documents, tell
  the labels apart; a large one on all other ordinary documents follows either of them.  It lies nearest to the window and
  holds what is usual, so both sides find the same matches for that, and lengths differ where only one side's own
  dictionary has something: for toxic text mostly the toxic one.
* A window is a run of whole words of ``WINDOW`` bytes or more of the lower-cased text, in a frame that gives the compressor
  room (it starts no match in the last bytes of its input).  Its distance is its length with the ordinary dictionaries
  less that with the toxic one.  Windows cover the whole text.
* A logistic curve over how many windows, and what share of them, reach each of ``THRESHOLDS``, their largest distance and
  their number, fitted to the calibration part with the labels' shares in all training rows, gives the score.

Null and empty texts have no window and get the curve's value for none.  Without labels of both kinds every score is the
share of label 1 in the sample, one half without any.  Of documents with one id the smallest text is learned from.  Repeated
rows are repeated; an empty table gives no rows.  Other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, ORDINARY = 1500, 9000
SAMPLE_BYTES = 24 << 20
#: Bytes of the dictionaries that tell the labels apart, and of the common one.
DICTIONARY, COMMON = 32_768, 1 << 20
LEVEL = 9
#: Bytes of the segments that training picks for either: left to its own choice it may return a much smaller dictionary.
SEGMENTS = (100, 500)
#: Bytes of text a window, words a sample that dictionaries are trained on.
WINDOW, TRAINED = 14, 40
THRESHOLDS = (2, 3, 4, 6)
#: Distances are cut off here: what reaches further is a passage that one sample happens to hold.
MOST = 8
#: The frame of a window: two strings that texts don't hold.
BEFORE, AFTER = b"0q7xj2wv9kz4hg6fz1bd8mt3cn5rl0sp7yq2", b"x4vj9wq1kz"


def windows(text: bytes) -> list[bytes]:
    """The words of a lower-cased text in runs of ``WINDOW`` bytes or more; the last may be shorter."""
    out, run, size = [], [], 0
    for word in text.lower().split():
        run.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" ".join(run))
            run, size = [], 0
    return [*out, b" ".join(run)] if run else out


def train(texts: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on the texts in pieces, or the texts themselves where they are too few to train on."""
    import zstandard

    pieces = [b" ".join(words[i : i + TRAINED]) for words in (t.lower().split() for t in texts) for i in range(0, len(words), TRAINED)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, pieces)) // 4), pieces, k=segment, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(pieces)[-size:]


class Distances:
    """Distances of the windows of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes, common: bytes) -> None:
        import zstandard

        found = []
        for own in (ordinary, toxic):
            known = zstandard.ZstdCompressionDict(own + common + BEFORE + AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_LAZY2)
            known.precompute_compress(compression_params=params)
            found.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress)
        self.ordinary, self.toxic = found

    def of(self, text: bytes) -> np.ndarray:
        framed = [BEFORE + b" " + w + b" " + AFTER for w in windows(text)]
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in framed], dtype=float)


def features(distance: np.ndarray) -> list[float]:
    """What the curve sees: a constant, numbers and shares of windows beyond thresholds, the largest distance, their number."""
    n, d = max(1, len(distance)), np.clip(distance, -MOST, MOST)
    beyond = [int((d >= t).sum()) for t in THRESHOLDS] + [int((d <= -THRESHOLDS[1]).sum())]
    return [1.0, *np.log1p(beyond), *(k / n for k in beyond), float(d.max(initial=0.0)), float(np.log1p(len(d)))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton steps for a weighted ridge-penalised logistic regression; the constant is hardly penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(toxic: list[bytes], ordinary: list[bytes], counts: tuple[int, int] | None = None):
    """(toxic, ordinary and common dictionary, coefficients), or the share of label 1.

    ``counts``: how many training rows there are of either label, if the lists are samples.
    """
    if not toxic or not ordinary:
        return (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
    all_toxic, all_ordinary = counts or (len(toxic), len(ordinary))
    a, b = len(toxic) // 3, min(len(ordinary) // 3, 2 * (len(toxic) // 3))
    if not a or not b:  # too few to keep apart
        checked, a, b = (toxic, ordinary), 0, 0
    else:
        checked = (toxic[:a], ordinary[:b])
    own, rest = toxic[a:], ordinary[b:]
    like = min(len(own), max(1, len(rest) // 2))
    dictionaries = train(own, DICTIONARY, SEGMENTS[0]), train(rest[:like], DICTIONARY, SEGMENTS[0]), train(rest[like:], COMMON, SEGMENTS[1])
    distances = Distances(*dictionaries)
    x = np.array([features(distances.of(t)) for side in checked for t in side])
    y = np.repeat([1.0, 0.0], [len(checked[0]), len(checked[1])])
    share = all_toxic / (all_toxic + all_ordinary)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    return *dictionaries, logistic(x / spread, y, weight) / spread


def sample(docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str, label_col: str, most: dict[int, int], most_bytes: int) -> tuple[dict[int, list[bytes]], dict[int, int]]:
    """Texts by label (1 or 0), of some ``most[label]`` training rows and ``most_bytes``, drawn by a hash of the id; numbers of all."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    marks = marks.groupBy("id").agg(F.max("y").cast("int").alias("y")).where(training)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sizes = texts.select("id", F.octet_length("text").alias("b")).join(marks, "id").groupBy("y").agg(F.countDistinct("id").alias("n"), F.sum("b").alias("b")).collect()
    counts, share = {r.y: r.n for r in sizes}, {r.y: min(1.0, most[r.y] / r.n, most_bytes / max(1, r.b)) for r in sizes}
    cells = 1 << 40
    draw = F.expr(f"pmod(xxhash64(3, id), {cells}L)")
    draw = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(cells))
    limits = " ".join(f"when {y} then {int(cells * s)}L" for y, s in share.items())
    chosen = marks.where(draw < F.expr(f"case y {limits} else 0L end" if limits else "0L"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # some sum of ``most`` rows
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(rows.select("y", "text", draw.alias("draw")).collect(), key=lambda r: (r.draw, r.text)):
        found[r.y].append(r.text.encode())
    return found, counts


def toxicity(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE, ordinary: int = ORDINARY, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, score, predicted.  Learns from labels where ``training`` (over ``id``) holds."""
    texts, counts = sample(docs, labels, training, id_col, text_col, label_col, {1: most, 0: ordinary}, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(learn(texts[1], texts[0], (counts.get(1, 0), counts.get(0, 0))))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if isinstance(model.value, float):
            yield from (pd.Series([model.value] * len(texts)) for texts in batches)
            return
        *dictionaries, w = model.value
        distances = Distances(*dictionaries)
        for texts in batches:
            x = np.array([features(distances.of((t or "").encode())) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    found = docs.select(F.col(id_col), score(F.col(text_col)).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
