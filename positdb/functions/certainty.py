"""Arithmetic on certainties, percentages from -100 to 100, and their consistency."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction(percent: Column) -> Column:
    return percent / F.lit(100.0)


def plus(a: Column, b: Column) -> Column:
    """Sum as a fraction, not bounded."""
    return fraction(a) + fraction(b)


def times(a: Column, b: Column) -> Column:
    return fraction(a) * fraction(b)


def weight(percent: Column) -> Column:
    """What an assertion adds to the total of its set, in percent: its certainty, and 100 for a denial."""
    return F.coalesce(F.when(percent < 0, percent + 100).otherwise(percent), F.lit(0))


def consistent(assertions: DataFrame, by: list[str], percent: str = "v_cert") -> DataFrame:
    """For each group, whether its certainties are consistent: their weights total 100 percent at most."""
    return assertions.groupBy(*by).agg((F.sum(weight(F.col(percent))) <= 100).alias("consistent"))


def all_consistent(percents: Iterable[int]) -> bool:
    return sum(p + 100 * (p < 0) for p in percents) <= 100
