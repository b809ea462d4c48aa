"""Annular sectors: struct<cx, cy, inner, outer, start, sweep> columns (radians)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import circle as c_
from . import lines
from . import polygon as pg
from . import vector as v
from .angle import TWO_PI, within
from .rect import corners, rect


def sector(cx, cy, inner, outer, start, sweep) -> Column:
    cols = (F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(float(k)) for k in (cx, cy, inner, outer, start, sweep))
    return F.struct(*(k.cast("double").alias(n) for k, n in zip(cols, ("cx", "cy", "inner", "outer", "start", "sweep"), strict=True)))


def center(s: Column) -> Column:
    return v.point(s["cx"], s["cy"])


def _span(s: Column) -> tuple[Column, Column]:
    """start and width of the angles it holds, whatever the sign of the sweep."""
    return F.when(s["sweep"] < 0, s["start"] + s["sweep"]).otherwise(s["start"]), F.least(F.abs(s["sweep"]), F.lit(TWO_PI))


def area(s: Column) -> Column:
    return F.abs(s["sweep"]) * (s["outer"] * s["outer"] - s["inner"] * s["inner"]) / 2


def perimeter(s: Column) -> Column:
    return (s["inner"] + s["outer"]) * F.abs(s["sweep"]) + 2 * (s["outer"] - s["inner"])


def end_angle(s: Column) -> Column:
    return s["start"] + s["sweep"]


def center_angle(s: Column) -> Column:
    return s["start"] + s["sweep"] / 2


def centroid(s: Column) -> Column:
    """The point at half the radii in the middle of the sweep."""
    return v.circle_point((s["inner"] + s["outer"]) / 2, center_angle(s), center(s))


def is_empty(s: Column) -> Column:
    return (F.abs(s["sweep"]) <= 1e-9) | (s["outer"] - s["inner"] <= 1e-9)


def bbox(s: Column) -> Column:
    """That of the outer circle."""
    return rect(s["cx"] - s["outer"], s["cy"] - s["outer"], s["cx"] + s["outer"], s["cy"] + s["outer"])


def boundary_points(s: Column) -> Column:
    return F.array(*(v.circle_point(s[r], a, center(s)) for r, a in (("inner", s["start"]), ("outer", s["start"]), ("outer", end_angle(s)), ("inner", end_angle(s)))))


def contains_point(s: Column, p: Column, eps: float = 1e-9) -> Column:
    d, (start, span) = v.distance(center(s), p), _span(s)
    return (d >= s["inner"] - eps) & (d <= s["outer"] + eps) & within(v.angle_of(p, center(s)), start, span, eps)


def contains_sector(s: Column, o: Column, eps: float = 1e-9) -> Column:
    """Radii and angles of o within those of s, about one centre."""
    (start, span), (other, width) = _span(s), _span(o)
    offset = F.pmod(other - start + eps, F.lit(TWO_PI)) - eps
    return (o["inner"] >= s["inner"] - eps) & (o["outer"] <= s["outer"] + eps) & ((span >= TWO_PI - eps) | (offset + width <= span + eps))


def _sides(s: Column) -> Column:
    ends = (s["start"], end_angle(s))
    return F.array(*(lines.segment(v.circle_point(s["inner"], a, center(s)), v.circle_point(s["outer"], a, center(s))) for a in ends))


def _arc_points(s: Column, segment: Column) -> Column:
    """Where a segment crosses the two arcs."""
    start, span = _span(s)
    hits = F.concat(*(c_.segment_cross_points(c_.circle(s["cx"], s["cy"], s[r]), segment) for r in ("inner", "outer")))
    return F.filter(hits, lambda p: within(v.angle_of(p, center(s)), start, span))


def overlaps_segment(s: Column, segment: Column) -> Column:
    return contains_point(s, segment["start"]) | contains_point(s, segment["end"]) | (F.size(_arc_points(s, segment)) > 0) | F.exists(_sides(s), lambda e: lines.intersects(e, segment))


def overlaps_polygon(s: Column, p: Column) -> Column:
    """Filled overlap; a sector inside the polygon counts."""
    return F.exists(pg.edges(p), lambda e: overlaps_segment(s, e)) | pg.contains_point(p, boundary_points(s)[1])


def overlaps_rect(s: Column, r: Column) -> Column:
    return overlaps_polygon(s, corners(r))


def distance_to_point(s: Column, p: Column) -> Column:
    start, span = _span(s)
    d = v.distance(center(s), p)
    radial = F.greatest(F.lit(0.0), s["inner"] - d, d - s["outer"])
    sides = F.array_min(F.transform(_sides(s), lambda e: lines.distance_to_point(e, p)))
    return F.when(within(v.angle_of(p, center(s)), start, span), radial).otherwise(sides)


def overlaps_circle(s: Column, c: Column) -> Column:
    """Exact: the circle's centre is within its radius of the sector."""
    return distance_to_point(s, c_.center(c)) <= c["r"]


def overlaps_sector(s: Column, o: Column, chords: int = 64) -> Column:
    """Against o's outline in chords; one inside the other counts."""
    return overlaps_polygon(s, polygonised(o, chords)) | contains_point(o, boundary_points(s)[1])


def polygonised(s: Column, chords: int | Column) -> Column:
    n = chords if isinstance(chords, Column) else F.lit(chords)
    arc = lambda r, back: F.transform(F.sequence(F.lit(0), n), lambda i: v.circle_point(s[r], s["start"] + s["sweep"] * ((n - i) if back else i) / n, center(s)))
    return F.concat(arc("outer", False), arc("inner", True))


def chords(radius: Column, sweep: Column) -> Column:
    """Chords that stay within one unit of an arc, three at least."""
    half = F.acos(F.greatest(F.lit(-1.0), 1 - 1 / radius))
    return F.greatest(F.lit(3), F.ceil(F.try_divide(F.abs(sweep), 2 * half)).cast("int"))


def arc_contains_point(s: Column, p: Column) -> Column:
    """Signed sweep, no tolerance; an empty arc holds nothing."""
    d2, turned = v.distance2(center(s), p), v.angle_of(p, center(s)) - s["start"]
    along = F.when(s["sweep"] >= 0, F.pmod(turned, F.lit(TWO_PI)) <= s["sweep"]).otherwise(F.pmod(-turned, F.lit(TWO_PI)) <= -s["sweep"])
    return ~is_empty(s) & (d2 >= s["inner"] * s["inner"]) & (d2 <= s["outer"] * s["outer"]) & ((F.abs(s["sweep"]) >= TWO_PI) | along)


def corner_offset(radius: Column, corner: Column) -> Column:
    """The angle that a corner of radius `corner` takes at an arc; null where it doesn't fit."""
    ratio = F.try_divide(corner, radius - corner)
    return F.when((ratio >= -1) & (ratio <= 1), F.asin(ratio))


def full_circle() -> float:
    return 2 * math.pi
