"""Snapshots and as-of joins over posits."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str | Column]


def snapshot(posits: DataFrame, at_hi: int | Column, by: Keys = ("aset_key",)) -> DataFrame:
    """For each set of appearances its latest posits not after a time; all of equal time stay.

    Between times that cover each other the one that begins later, then the more precise, is the later.
    """
    past = posits.where(F.col("t_lo") <= at_hi)
    latest = Window.partitionBy(*by).orderBy(F.desc("t_lo"), F.desc("t_prec"))
    return past.withColumn("__rank", F.rank().over(latest)).where("__rank = 1").drop("__rank")


def validity(posits: DataFrame, by: Keys = ("aset_key",), ident: str = "posit_id") -> DataFrame:
    """Posits with ``next_lo``, where the next of the same set begins; of equal times the smallest id stays."""
    order = Window.partitionBy(*by).orderBy("t_lo", F.desc("t_prec"), ident)
    single = posits.withColumn("__before", F.lag("t_lo").over(order)).where("__before is null or __before != t_lo").drop("__before")
    # Sorted by set and time already: the second window needs neither a shuffle nor a sort.
    return single.withColumn("next_lo", F.lead("t_lo").over(Window.partitionBy(*by).orderBy("t_lo")))


def valid_at(hi: Column, lo: Column, next_lo: Column) -> Column:
    """Whether the posit that begins at ``lo`` is the latest of its set not after a time that ends at ``hi``."""
    return (lo <= hi) & (next_lo.isNull() | (next_lo > hi))


def carried(left: DataFrame, hi: str, right: DataFrame, keys: list[str], lo: str, prec: str, ident: str) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of the same ``keys`` not after ``hi``; rows without one go.

    Both tables go through one window that carries the last row of ``right`` forward, so the work of a key grows with its
    rows, not with their pairs.  Of equal times the more precise, then the smallest id counts, as in ``validity``.
    """
    own = [c for c in right.columns if c not in keys]
    kept = F.struct(*[F.col(c) for c in own])
    l = left.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.col(hi).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns if c not in keys]).alias("__l"))  # noqa: E741
    r = right.select(*keys, F.col(lo).alias("__at"), F.lit(0).alias("__side"), F.col(prec).alias("__prec"), F.col(ident).alias("__id"), kept.alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__at", "__side", F.asc("__prec"), F.desc("__id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__last", F.last("__r", ignorenulls=True).over(order)).where("__side = 1 and __last is not null")
    return found.select(*[F.col(c) if c in keys else F.col(f"__l.{c}") for c in left.columns], *[F.col(f"__last.{c}") for c in own if c not in left.columns])
