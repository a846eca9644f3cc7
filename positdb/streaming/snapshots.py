"""The information in effect, kept up to date over a stream of posits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from positdb.sources.store import COLUMNS


def latest(posits: DataFrame) -> DataFrame:
    """For each set of appearances the latest posit of a batch or a stream (complete or update mode).

    State is one posit a set, however long the history.  Of equal times the smallest id stays, as a stream can't give
    several rows a key.
    """
    order = F.struct("t_lo", "t_prec", (-F.col("posit_id")).alias("x"))
    others = F.struct(*[c for c in COLUMNS if c != "aset_key"])
    return posits.groupBy("aset_key").agg(F.max_by(others, order).alias("p")).select("aset_key", "p.*").select(COLUMNS)
