"""Mixing of sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

1. A slim row per document: id, source, words, shard (of its source) and seeded position, written once.
2. Targets: sources weigh by a repeating pattern and share all words; a target stops at ``most_repeats`` times the
   source's words and the excess is shared anew.  In closed form: with sources sorted by words / weight, the stopped
   ones are a prefix, found from running sums.
3. The mix consists of equal blocks of words, ``block`` or so few that the smallest target has ``FINE`` of them (one word at
   least), so that small sources come near their targets too.  Blocks go to the sources, and each source's blocks to its shards,
   by highest quotients v / (2k + 1).  ``apportion`` finds the divisor at which the rounded seats fit by bisection,
   then gives the last seats by their quotients, so the work grows with the parties, not with the seats.
4. In a shard, documents lie in seeded order and are cut into equal blocks.  A quota takes every block as often as it
   goes in whole, and the rest as a run of blocks from a seeded start on, cyclically.  What a document gives is the
   overlap with its words: no row is made for a block.

A source holding a third of all rows is spread over the shards, ``shards`` or more, so that a shard has some
``SHARD_ROWS`` rows of it at most.  Two steps are held by one task: the table of sources, a row each, and the list of one
source's shards, two numbers each.  Null texts have 0 words; null sources form a
source of their own, last; repeated rows are taken for documents of their own; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from positdb.llm.common import WORD_PATTERN, stored

WEIGHTS = (5, 2, 1)
#: Blocks that the smallest target has at least, and rows of a source in a shard, more or less.
FINE, SHARD_ROWS = 64, 50_000


def apportion(df: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``df`` with ``quota``: in each group, its ``seats`` dealt to the parties by highest quotients.

    Ties go to the smaller ``party``.  Groups without votes get no seats.
    """
    packed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(party), F.col(votes).cast("double").alias("v")))).alias("parties"), F.first(seats).alias("m"))
    rounded = "cast(floor(p.v / {d} + 0.5D) as bigint)"
    total = "aggregate(parties, 0L, (n, p) -> n + " + rounded + ")"
    packed = packed.withColumn("all", F.expr("aggregate(parties, 0D, (n, p) -> n + p.v)")).where("all > 0 and m > 0")
    packed = packed.withColumn("d", F.expr(f"""aggregate(sequence(1, 80), named_struct('lo', all / (m + size(parties) / 2D + 1D), 'hi', 4D * all / m),
        (a, i) -> if({total.format(d="((a.lo + a.hi) / 2D)")} > m,
            named_struct('lo', (a.lo + a.hi) / 2D, 'hi', a.hi), named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2D))).hi"""))
    packed = packed.withColumn("left", F.col("m") - F.expr(total.format(d="d")))
    each = packed.select(*group, "left", "d", F.explode("parties").alias("p")).withColumn("q", F.expr(rounded.format(d="d")))
    by_quotient = Window.partitionBy(*group).orderBy(F.expr("p.v / (2D * q + 1D)").desc(), F.col(f"p.{party}"))
    each = each.withColumn("quota", F.col("q") + F.when(F.row_number().over(by_quotient) <= F.col("left"), 1).otherwise(0))
    dealt = each.select(*group, F.col(f"p.{party}").alias(party), "quota")
    return df.join(dealt, [*group, party], "left").fillna(0, ["quota"])


def targets(sources: DataFrame, weights: tuple[float, ...], most_repeats: float) -> DataFrame:
    """``sources`` (key, source, source_size) with ``target``; one row a source."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.element_at(pattern, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * float(most_repeats)).withColumn("ratio", F.col("limit") / F.col("w"))
    every, order = Window.partitionBy(), Window.orderBy("ratio", "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level).withColumn("stopped", F.col("level") > F.col("ratio"))
    last = F.min_by(F.when(~F.col("stopped"), F.col("level")), F.when(~F.col("stopped"), F.col("ratio"))).over(every)
    return ranked.select("key", "source_size", F.when(F.col("stopped"), F.col("limit")).otherwise(last * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = 3, block: int = 32, shards: int = 512, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words the mix takes, repeats counted), ``carried``."""
    shards = max(shards, -(-docs.count() // SHARD_ROWS))
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(shards)).alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("place"),
        *carried,
    ).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # null and empty names differ
    slim = stored(slim, "sizes")
    parts = slim.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    parts = stored(parts, "shards")
    sources = parts.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    sources = stored(targets(sources, weights, most_repeats), "targets")
    least = sources.where("target > 0").agg(F.min("target").alias("t")).first().t
    block = max(1, min(block, int((least or 0) // FINE)))
    every = F.sum("source_size").over(Window.partitionBy())
    sources = apportion(sources.withColumn("one", F.lit(1)).withColumn("m", F.round(every / block).cast("long")), ["one"], "key", "target", "m")
    sources = stored(sources.select("key", "source_size", "target", F.col("quota").alias("blocks")), "sources")
    parts = apportion(parts.select("key", "shard", "words").join(sources, "key"), ["key"], "shard", "words", "blocks")
    # Equal blocks: their number is the nearest to words / block, boundaries lie at floor(k * words / cuts).
    parts = parts.withColumn("cuts", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    parts = parts.withColumn("whole", F.expr("quota div cuts")).withColumn("rest", F.expr("quota % cuts"))
    parts = parts.withColumn("first", F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.col("cuts")))
    edge = "({k} * (words div cuts) + ({k} * (words % cuts)) div cuts)"
    parts = parts.withColumn("x0", F.expr(edge.format(k="first")))
    parts = parts.withColumn("x1", F.expr(f"if(first + rest > cuts, words + {edge.format(k='(first + rest - cuts)')}, {edge.format(k='(first + rest)')})"))
    parts = stored(parts.select("key", "shard", "source_size", "target", "words", "whole", "x0", "x1"), "quotas")
    order = Window.partitionBy("key", "shard").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("a", F.coalesce(F.sum("size").over(order), F.lit(0))).join(parts, ["key", "shard"])
    overlap = "greatest(0, least(a + size, x1) - greatest(a, x0)) + greatest(0, least(a + size, x1 - words) - a)"
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.least(F.col("size") * most_repeats, F.expr(f"whole * size + {overlap}")).cast("long").alias("taken"),
        *carried,
    )
