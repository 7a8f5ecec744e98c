"""Ranks, running sums and neighbours in a total order without a task that holds all rows.

Rows are dealt by range and written; the totals of the ranges (a row each) are summed,
and inside a range an ordinary window does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_part``, the number of its range; fixed by being written."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def prefixes(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over all rows that come before, in an order without ties."""
    d = ranges(df, order)
    totals = d.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select(F.col("_part").alias("_tp"), *[F.coalesce(F.sum(f"_t_{k}").over(up), F.lit(0)).alias(f"_b_{k}") for k in sums])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(F.broadcast(totals), F.col("_part") == F.col("_tp"))
    return out.select(*df.columns, *[(F.col(f"_b_{k}") + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(k) for k, v in sums.items()])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0."""
    return prefixes(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name).cast("long"))


def followed(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` (distinct ``x``) with the next larger x as ``name``, null at the last."""
    d = ranges(df, [x])
    later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    firsts = d.groupBy("_part").agg(F.min(x).alias("_first")).select(F.col("_part").alias("_tp"), F.min("_first").over(later).alias("_next"))
    out = d.join(F.broadcast(firsts), F.col("_part") == F.col("_tp"))
    return out.select(*df.columns, F.coalesce(F.lead(x).over(Window.partitionBy("_part").orderBy(x)), F.col("_next")).alias(name))


def preceded(df: DataFrame, x: str, value: str, name: str) -> DataFrame:
    """``df`` (distinct ``x``) with ``value`` of the row before, null at the first."""
    d = ranges(df, [x])
    lasts = d.groupBy("_part").agg(F.max(F.struct(F.col(x), F.col(value).alias("v"))).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(F.col("_part").alias("_tp"), F.max("_last").over(earlier).alias("_prev"))
    out = d.join(F.broadcast(lasts), F.col("_part") == F.col("_tp"))
    return out.select(*df.columns, F.coalesce(F.lag(value).over(Window.partitionBy("_part").orderBy(x)), F.col("_prev.v")).alias(name))
