"""Circles: struct<cx, cy, r: double> columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lines
from . import vector as v
from .rect import corners, rect


def circle(cx, cy, r) -> Column:
    p = v.point(cx, cy)
    r = F.col(r) if isinstance(r, str) else r if isinstance(r, Column) else F.lit(float(r))
    return F.struct(p["x"].alias("cx"), p["y"].alias("cy"), r.cast("double").alias("r"))


def center(c: Column) -> Column:
    return v.point(c["cx"], c["cy"])


def area(c: Column) -> Column:
    return math.pi * c["r"] * c["r"]


def length(c: Column) -> Column:
    return 2 * math.pi * c["r"]


def bbox(c: Column) -> Column:
    return rect(c["cx"] - c["r"], c["cy"] - c["r"], c["cx"] + c["r"], c["cy"] + c["r"])


def contains_point(c: Column, p: Column, eps: float = 1e-9, closed: bool = True) -> Column:
    d2 = v.distance2(center(c), p)
    return d2 <= c["r"] * c["r"] + eps if closed else d2 < c["r"] * c["r"]


def contains_rect(c: Column, r: Column) -> Column:
    """All corners strictly inside."""
    return F.forall(corners(r), lambda p: contains_point(c, p, closed=False))


def boundary_intersects(c: Column, o: Column) -> Column:
    d = v.distance(center(c), center(o))
    return (d >= F.abs(c["r"] - o["r"])) & (d <= c["r"] + o["r"])


def overlaps(c: Column, o: Column) -> Column:
    return v.distance(center(c), center(o)) <= c["r"] + o["r"]


def overlaps_rect(c: Column, r: Column) -> Column:
    dx = F.greatest(r["xmin"] - c["cx"], F.lit(0.0), c["cx"] - r["xmax"])
    dy = F.greatest(r["ymin"] - c["cy"], F.lit(0.0), c["cy"] - r["ymax"])
    return dx * dx + dy * dy <= c["r"] * c["r"]


def cross_points(c: Column, o: Column) -> Column:
    """The points in which two circles meet, 0 to 2; touching circles give one; null if concentric."""
    p, q = center(c), center(o)
    d = v.distance(p, q)
    a = F.try_divide(c["r"] * c["r"] - o["r"] * o["r"] + d * d, 2 * d)
    h2 = c["r"] * c["r"] - a * a
    h, u = F.sqrt(F.greatest(h2, F.lit(0.0))), v.unit(v.sub(q, p))
    base = v.add(p, v.scale(u, a))
    plus, minus = (v.point(base["x"] - k * h * u["y"], base["y"] + k * h * u["x"]) for k in (1, -1))
    apart = (d > c["r"] + o["r"] + 1e-10) | (d < F.abs(c["r"] - o["r"]) - 1e-10)
    return F.when(d == 0, F.lit(None)).when(apart, F.array().cast("array<struct<x:double,y:double>>")).when(h < 1e-10, F.array(plus)).otherwise(F.array(plus, minus))


def segment_cross_points(c: Column, s: Column, eps: float = 1e-10) -> Column:
    """The points of the circle's boundary on a segment, in the segment's direction."""
    d, f = v.sub(s["end"], s["start"]), v.sub(s["start"], center(c))
    a, b, k = v.dot(d, d), 2 * v.dot(f, d), v.dot(f, f) - c["r"] * c["r"]
    disc = b * b - 4 * a * k
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    ts = F.when(F.abs(disc) <= eps, F.array(F.try_divide(-b, 2 * a))).otherwise(F.array(F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)))
    kept = F.filter(ts, lambda t: (t >= -eps) & (t <= 1 + eps) & (disc >= -eps))
    return F.transform(kept, lambda t: v.lerp(s["start"], s["end"], t))


def boundary_meets_segment(c: Column, s: Column) -> Column:
    """Whether the boundary meets a segment; a segment of no length counts as a point of the disc."""
    return F.when(lines.length(s) == 0, contains_point(c, s["start"])).otherwise(F.size(segment_cross_points(c, s, 1e-9)) > 0)


def distance_to_point(c: Column, p: Column) -> Column:
    return F.greatest(F.lit(0.0), v.distance(center(c), p) - c["r"])


def distance(c: Column, o: Column) -> Column:
    return F.greatest(F.lit(0.0), v.distance(center(c), center(o)) - c["r"] - o["r"])


def distance_to_segment(c: Column, s: Column) -> Column:
    return F.greatest(F.lit(0.0), lines.distance_to_point(s, center(c)) - c["r"])


def polygonised(c: Column, n: Column | int) -> Column:
    """n points of the circle, from angle zero on."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: v.circle_point(c["r"], i * F.lit(2 * math.pi) / n, center(c)))
