"""Positions within groups that may be large: a group is cut by time, so that no task orders all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: FILETIME ticks of 30 days.
WIDTH = 30 * 864_000_000_000


def positions(df: DataFrame, key: str, time: str, tie: str, width: int = WIDTH) -> DataFrame:
    """Adds pos (from 1) and group_size: the order within the key by time (missing last), then tie.

    Rows are ordered within a stretch of time; the rows of earlier stretches are counted apart, from one row for each
    key and stretch. Rows without a time are a stretch of their own."""
    cut = df.withColumn("_stretch", F.floor(F.col(time) / width).cast("long"))
    sizes = cut.groupBy(key, "_stretch").agg(F.count("*").alias("_n"))
    by_time = W.partitionBy(key).orderBy(F.col("_stretch").asc_nulls_last())
    before = sizes.select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), (F.sum("_n").over(by_time.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(key)).alias("group_size"))
    inside = F.row_number().over(W.partitionBy(key, "_stretch").orderBy(F.col(time).asc_nulls_last(), tie))
    ranked = cut.withColumn("_rank", inside)
    joined = ranked.join(before, ranked[key].eqNullSafe(F.col("_key")) & ranked["_stretch"].eqNullSafe(F.col("_at")))
    return joined.withColumn("pos", (F.col("_before") + F.col("_rank")).cast("long")).drop("_stretch", "_rank", "_key", "_at", "_before")
