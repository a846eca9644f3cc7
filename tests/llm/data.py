"""Small tables with the cases that operators must stand."""

import random
import zlib

WORDS = "the of and to in a is that it for on was be with as by this are from or had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def texts(seed: int = 1, n: int = 60) -> list[str]:
    """Prose, with exact copies, near copies, copies of other case, and one very long text."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.random()
        if out and kind < 0.15:
            out.append(rnd.choice(out))
        elif out and kind < 0.45:
            words = rnd.choice(out).split()
            for _ in range(rnd.randint(1, 1 + len(words) // 12)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
            out.append(" ".join(words))
        elif out and kind < 0.5:
            out.append(rnd.choice(out).upper())
        else:
            out.append(" ".join(rnd.choices(WORDS, k=rnd.randint(1, 120))) + rnd.choice(["", ".", "!\n"]))
    out.append(" ".join(rnd.choices(WORDS, k=9000)))
    return out


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): with nulls, empty texts, odd white space, and a repeated row."""
    rnd = random.Random(seed + 100)
    odd = [None, "", "   \n\t", "one", "two words", "Two words", "\x1ca\x1cb c", "a b　c é ß İ", "<|endoftext|> x <|startoftext|>", "1 2 3 !!! ???", "ab " * 50]
    every = texts(seed, n) + odd
    found = [(i * 3 + 1, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None, "", "é"]), len(t or "")) for i, t in enumerate(every)]
    return [*found, found[5], found[5]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, found=None, extra=True):
    df = spark.createDataFrame(rows() if found is None else found, SCHEMA).repartition(3)
    if extra:  # columns of names that operators use inside
        from pyspark.sql import functions as F

        for name in ("id", "n", "key", "size", "digest", "piece", "rank", "score", "c1", "uid", "word", "bucket", "target", "keep_id"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())
