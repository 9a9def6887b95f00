"""Reports: one row of counters turned into (ord, key, value) rows in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(row: DataFrame) -> DataFrame:
    """A row for each column of a one-row DataFrame: ord (0 first), key, value long."""
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for i, c in enumerate(row.columns)))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def counted(df: DataFrame, **counters: Column) -> DataFrame:
    return df.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counters.items()))


def triple(name: str, n: str) -> dict[str, Column]:
    """How many rows have any, the total, and the most, of a count column."""
    c = F.col(n)
    return {f"{name}_with_any": F.count_if(c > 0), f"{name}_total": F.sum(c), f"{name}_max": F.max(c)}


def histogram(df: DataFrame, key: Column, name: str = "bucket") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
