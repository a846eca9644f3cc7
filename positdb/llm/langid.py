"""Language identification by string kernels with Nyström landmarks and kernel ridge regression.

* Kernel: blended spectrum, presence form.  For every n-gram length the common distinct n-grams are counted and
  divided by the geometric mean of the two numbers of distinct n-grams; the lengths are summed.
* Learning, on the driver: a sample of ``SAMPLE`` labelled documents a language at most (expected; drawn by a hash of
  the id), ``LANDMARKS`` of them a language as landmarks, one ridge regression of +1 / -1 a language on the kernel
  values at the landmarks (Nyström form).  That bound is the only one: counts of languages cover all rows.
* Scoring: the kernel is linear in a document's presence vector, so landmarks and coefficients fold into one matrix
  n-grams x languages; a batch of documents is scored by one sparse matrix product with it.

N-grams are taken over the lower-cased letters of the whole text, all else being one separator, and hashed to
``CELLS`` columns a length.  ``und`` with score 0 is the answer for null texts and texts without letters; a training
set without any language answers ``und`` throughout.  Repeated rows are repeated; an empty table gives no rows; null
ids count as training rows.  Other columns are ignored.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (2, 3, 4)
CELLS = 1 << 15
SAMPLE, LANDMARKS = 400, 32
RIDGE = 1e-4


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the n-grams present, ascending, and how many of them each length has; none without letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    alpha = letters()[code]
    if not alpha.any():
        return np.zeros(0, dtype=np.int64), np.zeros(len(LENGTHS), dtype=np.int64)
    code = np.where(alpha, code, 32)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # one separator after a word stands for all
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint32)
    found, sizes = [], []
    h = code * np.uint32(0x9E3779B1)
    for n in range(2, LENGTHS[-1] + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1 :] * np.uint32(0x9E3779B1)
        if n in LENGTHS:
            seen = np.zeros(CELLS, dtype=bool)
            seen[((h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)) >> np.uint32(17)] = True
            at = np.flatnonzero(seen)
            found.append(at + LENGTHS.index(n) * CELLS), sizes.append(len(at))
    return np.concatenate(found), np.array(sizes)


def scale(sizes: np.ndarray) -> np.ndarray:
    """What each column present counts for: one over the root of its length's number of columns."""
    return np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes).astype(np.float32)


def learn(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix columns x languages that scores a presence vector."""
    names = sorted(set(langs))
    rows = [presence(t) for t in texts]
    usable = [i for i, (at, _) in enumerate(rows) if len(at)]
    chosen = [i for name in names for i in [k for k in usable if langs[k] == name][:landmarks]]
    if not chosen:
        return [], np.zeros((CELLS * len(LENGTHS), 0), dtype=np.float32)
    marks = np.zeros((CELLS * len(LENGTHS), len(chosen)), dtype=np.float32)
    for j, i in enumerate(chosen):
        marks[rows[i][0], j] = scale(rows[i][1])
    kernel = np.stack([scale(rows[i][1]) @ marks[rows[i][0]] for i in usable]).astype(float)
    own = kernel[[usable.index(i) for i in chosen]]
    goal = np.array([[1.0 if langs[i] == name else -1.0 for name in names] for i in usable])
    # every language weighs the same, however many rows it has
    share = np.array([1 / sum(langs[k] == langs[i] for k in usable) for i in usable])[:, None]
    left = kernel.T @ (share * kernel) + ridge * own + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.lstsq(left, kernel.T @ (share * goal), rcond=None)[0]
    return names, (marks @ alpha).astype(np.float32)


def sample(docs: DataFrame, training: Column, id_col: str, text_col: str, lang_col: str, most: int) -> tuple[list[str], list[str]]:
    """Texts and languages of some ``most`` training rows a language, drawn by a hash of id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), training.alias("t"))
    rows = rows.where("t is not false and text is not null and lang is not null")
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return [], []
    cells = 1 << 40
    limits = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(cells, cells * most // r["count"])))])
    drawn = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(cells)) < F.element_at(limits, F.col("lang")))
    found = sorted((r.text, r.lang) for r in drawn.select("text", "lang").collect())
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(found))
    return [found[i][0] for i in order], [found[i][1] for i in order]


def classifier(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE, unlearned: str = "und"):
    """A function of a text column that gives the struct (lang_pred, score), learned from ``docs``.

    ``unlearned`` is the answer for texts with letters if no language was learned.
    """
    texts, langs = sample(docs, training, id_col, text_col, lang_col, most)
    model = docs.sparkSession.sparkContext.broadcast(learn(texts, langs))  # columns x languages

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, matrix = model.value
        for texts in batches:
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for first in range(0, len(texts), 128):
                rows = [(i, *presence(t)) for i, t in enumerate(texts[first : first + 128], first) if t]
                rows = [r for r in rows if len(r[1])]
                if not names:
                    for i, *_ in rows:
                        pred[i] = unlearned
                if not rows or not names:
                    continue
                at = np.concatenate([r[1] for r in rows])
                weight = np.concatenate([scale(r[2]) for r in rows])[:, None]
                value = np.add.reduceat(matrix[at] * weight, np.cumsum([0, *(len(r[1]) for r in rows[:-1])]), axis=0).astype(float)
                odds = np.exp(4 * (value - value.max(axis=1, keepdims=True)))
                odds /= odds.sum(axis=1, keepdims=True)
                for (i, _, _), p in zip(rows, odds):
                    k = int(p.argmax())
                    pred[i], score[i] = names[k], float(p[k])
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return language


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.  Learns from rows where ``training`` holds."""
    language = classifier(docs, training, id_col, text_col, lang_col, most)
    found = docs.select(F.col(id_col), language(F.col(text_col)).alias("found"))
    return found.select(id_col, "found.lang_pred", "found.score")
