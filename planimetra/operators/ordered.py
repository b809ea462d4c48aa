"""Ordered multisets and priority queues as DataFrames: whatever tree or heap would hold them, the rows are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def add(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Keeps ties."""
    return df.unionByName(rows)


def contains(df: DataFrame, key: str, probes: DataFrame) -> DataFrame:
    """probes that occur in df."""
    return probes.join(df.select(key), key, "left_semi")


def remove_one(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df without one occurrence for each of rows; rows that don't occur do nothing."""
    return df.exceptAll(rows.select(*df.columns))


def least(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias(key))


def greatest(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.max(key).alias(key))


def ascending(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def _ranges(df: DataFrame, *keys: str) -> DataFrame:
    """df sorted side by side in ranges of keys, with _range and _at, which grows with the order
    in a range and over ranges."""
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_range", F.shiftright("_at", 33))  # the id counts rows below, and partitions from there


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """df with place, 1 to n in the order of keys: ranges of keys are sorted side by side, and a
    running sum of the ranges' counts (one row each) shifts their places."""
    rows, low = _ranges(df, *keys), (1 << 33) - 1
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(counts), "_range").select(*df.columns, (F.col("_at").bitwiseAND(F.lit(low)) + F.col("_first") + 1).alias("place"))


def head(df: DataFrame, n: int, *keys: str, highest: bool = False) -> DataFrame:
    """The first n pops of a heap: a bounded top-k in each task, merged at the end."""
    return df.orderBy(*[F.desc(k) if highest else F.asc(k) for k in keys]).limit(n)


def is_ordered(df: DataFrame, position: str, key: str, partition: str | None = None) -> DataFrame:
    """valid: whether key never falls as position grows (within partitions, if given). Ranges of
    positions are looked at side by side, then the ends of each (one row a range) against the next."""
    groups = [F.lit(0).alias("_of") if partition is None else F.col(partition).alias("_of")]
    rows = _ranges(df.select(*groups, F.col(position).alias("_p"), F.col(key).alias("_k")), "_of", "_p")
    inside, over = Window.partitionBy("_of", "_range").orderBy("_at"), Window.partitionBy("_of").orderBy("_range")
    near = rows.withColumn("_ok", F.lag("_k").over(inside) <= F.col("_k"))
    ranges = near.groupBy("_of", "_range").agg(F.min("_ok").alias("_ok"), F.min_by("_k", "_at").alias("_first"), F.max_by("_k", "_at").alias("_last"))
    ranges = ranges.withColumn("_next", F.lag("_last").over(over) <= F.col("_first"))
    return ranges.agg(F.coalesce(F.min(F.least("_ok", "_next")), F.lit(True)).alias("valid"))


def is_heap(df: DataFrame, index: str, key: str) -> DataFrame:
    """valid: whether rows numbered from 0 form a min-heap; equal keys are in order."""
    parent = df.select(F.col(index).alias("_p"), F.col(key).alias("_pk"))
    kids = df.where(F.col(index) > 0).withColumn("_p", F.floor((F.col(index) - 1) / 2))
    return kids.join(parent, "_p").agg(F.coalesce(F.min(F.col("_pk") <= F.col(key)), F.lit(True)).alias("valid"))


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("size"))
