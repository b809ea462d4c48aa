"""Polylines: ordered points (path_id, ord, x, y), cut and measured along their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines
from ..functions import vector as v


def segments(df: DataFrame) -> DataFrame:
    """path_id, seg, a, b, length, start (length before it), total (of the path)."""
    w = Window.partitionBy("path_id").orderBy("ord")
    rows = df.select("path_id", "ord", (F.row_number().over(w) - 1).alias("seg"), v.point("x", "y").alias("a"), F.lead(v.point("x", "y")).over(w).alias("b")).where("b is not null")
    rows = rows.withColumn("length", v.distance(F.col("a"), F.col("b")))
    upto = Window.partitionBy("path_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("length").over(upto) - F.col("length"))
    return rows.withColumn("total", F.sum("length").over(Window.partitionBy("path_id"))).drop("ord")


def length(df: DataFrame) -> DataFrame:
    return segments(df).groupBy("path_id").agg(F.sum("length").alias("length"))


def _at(at: Column) -> Column:
    return v.lerp(F.col("a"), F.col("b"), F.coalesce(F.try_divide(at - F.col("start"), F.col("length")), F.lit(0.0)))


def point_at(df: DataFrame, at: float, share: bool = False) -> DataFrame:
    """path_id, p: the point at a length (or share of it); lengths outside are clamped."""
    want = F.greatest(F.lit(0.0), F.least(F.col("total") * at if share else F.lit(float(at)), F.col("total")))
    rows = segments(df).withColumn("want", want).where("start <= want and want <= start + length")
    return rows.groupBy("path_id").agg(F.min_by(_at(F.col("want")), "seg").alias("p"))


def first_point(df: DataFrame) -> DataFrame:
    """The point one unit along the path."""
    return point_at(df, 1.0)


def last_point(df: DataFrame) -> DataFrame:
    return point_at(df, 1.0, share=True)


def prefix(df: DataFrame, share: float) -> DataFrame:
    """path_id, seg, a, b: the first share of each path's length."""
    rows = segments(df).withColumn("stop", F.col("total") * share).where("start < stop")
    return rows.select("path_id", "seg", "a", F.when(F.col("start") + F.col("length") <= F.col("stop"), F.col("b")).otherwise(_at(F.col("stop"))).alias("b"))


def _intervals(df: DataFrame, period: float, on: float, phase: float = 0.0) -> DataFrame:
    """Parts of segments in the intervals [k period - phase, + on): path_id, piece, seg, a, b."""
    rows = segments(df).where("length > 0")
    k = F.sequence(F.floor((F.col("start") + phase) / period), F.floor((F.col("start") + F.col("length") + phase) / period))
    rows = rows.withColumn("piece", F.explode(k))
    low = F.greatest(F.col("start"), F.col("piece") * period - phase)
    high = F.least(F.col("start") + F.col("length"), F.col("piece") * period - phase + on)
    return rows.where(low < high).select("path_id", "piece", "seg", _at(low).alias("a"), _at(high).alias("b"))


def dashes(df: DataFrame, dash: float, gap: float | None = None, phase: float = 0.0) -> DataFrame:
    """path_id, piece, seg, a, b: the dashes of a path; the gap is as long as a dash unless given."""
    gap = dash if gap is None else gap
    return _intervals(df, dash + gap, dash, phase)


def split(df: DataFrame, most: float = 300) -> DataFrame:
    """path_id, piece, seg, a, b: pieces of at most `most` units."""
    return _intervals(df, most, most)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The points of first, then those of second backwards: a closed outline for each path_id."""
    a = first.select("path_id", F.lit(0).alias("_part"), F.col("ord").cast("double").alias("_o"), "x", "y")
    b = second.select("path_id", F.lit(1), (-F.col("ord")).cast("double"), "x", "y")
    return a.union(b).select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("_part", "_o")) - 1).alias("ord"), "x", "y")


def clipped(df: DataFrame, r: Column) -> DataFrame:
    """path_id, seg, a, b: each segment's part in a closed box, pieces apart staying apart."""
    rows = segments(df).withColumn("s", lines.clip(lines.segment(F.col("a"), F.col("b")), r)).where("s is not null")
    return rows.select("path_id", "seg", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
