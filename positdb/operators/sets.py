"""Set operators over one-column tables of things."""

from pyspark.sql import DataFrame


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def insert(a: DataFrame, things: list[int]) -> DataFrame:
    """``a`` with more things."""
    return union(a, a.sparkSession.createDataFrame([(t,) for t in things], a.schema))
