"""A hash chain over the posits in the order they were added.

An entry's hash covers the posit's content and the hash of the entry before, so appending is sequential: the driver chains
what a script adds, and tables in order of their ids, a partition's rows at a time, written in batches of ``BATCH``.
Verification isn't sequential: every entry is checked against the stored hash before it, all entries in parallel.
"""

import hashlib
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64
SCHEMA = "seq long, posit_id long, prev string, hash string"
#: Entries that are held at once while a table is chained.
BATCH = 200_000


def payload(posit_id, key: str, vt: int, text: str, time: str) -> str:
    return "|".join((str(posit_id), key, str(vt), text, time))


def payload_column():
    return F.concat_ws("|", F.col("posit_id").cast("string"), "aset_key", F.col("vt").cast("string"), "v_text", "t_text")


def chain(payloads: list[tuple[int, str]], prev: str = GENESIS, seq: int = 0) -> list[tuple[int, int, str, str]]:
    """Entries (seq, posit_id, prev, hash) for payloads in order."""
    out = []
    for posit_id, text in payloads:
        seq += 1
        now = hashlib.sha256(f"{text}|prev={prev}".encode()).hexdigest()
        out.append((seq, posit_id, prev, now))
        prev = now
    return out


def append(store, rows: list[tuple]) -> None:
    """Chain rows of the posit table that were just added to a store with a path."""
    last = head(store)
    entries = chain([(r[0], payload(r[0], r[1], r[4], r[5], r[-1])) for r in rows], last[0], last[1])
    store.spark.createDataFrame(entries, SCHEMA).coalesce(1).write.mode("append").parquet(f"{store.path}/ledger")


def append_frame(store, posits: DataFrame) -> None:
    """Chain a table of posits that is being added to a store with a path, in order of ids, ``BATCH`` entries at a time."""
    prev, seq = head(store)
    ordered = posits.select("posit_id", payload_column().alias("payload")).orderBy("posit_id").toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(ordered, BATCH)):
        entries = chain([(r.posit_id, r.payload) for r in batch], prev, seq)
        prev, seq = entries[-1][3], entries[-1][0]
        store.spark.createDataFrame(entries, SCHEMA).coalesce(1).write.mode("append").parquet(f"{store.path}/ledger")


def head(store) -> tuple[str, int]:
    """The newest hash and the number of entries."""
    if not store.path or not store._exists("ledger"):
        return GENESIS, 0
    found = store._read("ledger").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq")).first()
    return found.hash or GENESIS, found.seq or 0


def checked(posits: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with ``ok``: the hash fits the posit and the entry before, and that entry is the one linked to.

    The entry before comes by a join on the sequence number, so nothing is ordered in one task.
    """
    before = entries.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    content = posits.select("posit_id", payload_column().alias("payload"))
    found = entries.join(before, "seq", "left").join(content, "posit_id", "left")
    fits = F.sha2(F.concat(F.col("payload"), F.lit("|prev="), F.col("prev")).cast("binary"), 256) == F.col("hash")
    linked = F.col("prev") == F.coalesce("before", F.lit(GENESIS))
    return found.select("seq", "posit_id", F.coalesce(fits & linked, F.lit(False)).alias("ok"))


def verify(store) -> dict:
    """Number of entries and of mismatches, and the first one's posit."""
    if not store.path or not store._exists("ledger"):
        return {"entries": 0, "mismatches": 0, "first": None}
    state = checked(store.posits(), store._read("ledger"))
    r = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.min_by("posit_id", F.when(~F.col("ok"), F.col("seq"))).alias("first")).first()
    return {"entries": r.n, "mismatches": r.bad, "first": r.first if r.bad else None}
