"""Axis-parallel boxes: struct<xmin, ymin, xmax, ymax: double> columns, and bounds as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import point


def rect(xmin, ymin, xmax, ymax) -> Column:
    cols = (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in (xmin, ymin, xmax, ymax))
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(cols, ("xmin", "ymin", "xmax", "ymax"), strict=True)))


def contains_point(r: Column, p: Column, closed: bool = True) -> Column:
    """Closed, or half-open: the greatest edges left out."""
    low = (p["x"] >= r["xmin"]) & (p["y"] >= r["ymin"])
    return low & (p["x"] <= r["xmax"]) & (p["y"] <= r["ymax"]) if closed else low & (p["x"] < r["xmax"]) & (p["y"] < r["ymax"])


def contains(r: Column, s: Column) -> Column:
    return (r["xmin"] <= s["xmin"]) & (r["ymin"] <= s["ymin"]) & (s["xmax"] <= r["xmax"]) & (s["ymax"] <= r["ymax"])


def intersects(r: Column, s: Column) -> Column:
    return (r["xmin"] <= s["xmax"]) & (r["xmax"] >= s["xmin"]) & (r["ymin"] <= s["ymax"]) & (r["ymax"] >= s["ymin"])


def area(r: Column) -> Column:
    return (r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"])


def margin(r: Column) -> Column:
    return (r["xmax"] - r["xmin"]) + (r["ymax"] - r["ymin"])


def union(r: Column, s: Column) -> Column:
    return rect(F.least(r["xmin"], s["xmin"]), F.least(r["ymin"], s["ymin"]), F.greatest(r["xmax"], s["xmax"]), F.greatest(r["ymax"], s["ymax"]))


def union_area(r: Column, s: Column) -> Column:
    return area(union(r, s))


def intersection_area(r: Column, s: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(r[hi], s[hi]) - F.greatest(r[lo], s[lo]))
    return side("xmin", "xmax") * side("ymin", "ymax")


def deflate(r: Column, dx: Column | float, dy: Column | float) -> Column:
    return rect(r["xmin"] + dx, r["ymin"] + dy, r["xmax"] - dx, r["ymax"] - dy)


def center(r: Column) -> Column:
    return point((r["xmin"] + r["xmax"]) / 2, (r["ymin"] + r["ymax"]) / 2)


def corners(r: Column) -> Column:
    return F.array(point(r["xmin"], r["ymin"]), point(r["xmax"], r["ymin"]), point(r["xmax"], r["ymax"]), point(r["xmin"], r["ymax"]))


def contains_polygon(r: Column, vertices: Column) -> Column:
    return F.forall(vertices, lambda p: contains_point(r, p))


def to_string(r: Column) -> Column:
    return F.format_string("[%.2f,%.2f,%.2f,%.2f]", r["xmin"], r["ymin"], r["xmax"], r["ymax"])


def bounds(p: Column) -> Column:
    """The box of a group's points, as an aggregate; null points are skipped."""
    return F.struct(F.min(p["x"]).alias("xmin"), F.min(p["y"]).alias("ymin"), F.max(p["x"]).alias("xmax"), F.max(p["y"]).alias("ymax"))


def bounds_of_rects(r: Column) -> Column:
    return F.struct(F.min(r["xmin"]).alias("xmin"), F.min(r["ymin"]).alias("ymin"), F.max(r["xmax"]).alias("xmax"), F.max(r["ymax"]).alias("ymax"))
