"""Segments, rays and lines: struct<start, end> columns. `low` and `high` bound the parameter
along start to end: a segment has 0 to 1, a ray no upper bound, a line none at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vector as v
from .rect import rect

SEGMENT, RAY, LINE = (0.0, 1.0), (0.0, None), (None, None)


def segment(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def length(s: Column) -> Column:
    return v.distance(s["start"], s["end"])


def center(s: Column) -> Column:
    return v.midpoint(s["start"], s["end"])


def bbox(s: Column) -> Column:
    a, b = s["start"], s["end"]
    return rect(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))


def unit_vector(s: Column) -> Column:
    return v.unit(v.sub(s["end"], s["start"]))


def _in(t: Column, span: tuple, eps: float) -> Column:
    test = t.isNotNull()
    if span[0] is not None:
        test &= t >= span[0] - eps
    if span[1] is not None:
        test &= t <= span[1] + eps
    return test


def cross_point(s: Column, o: Column, kind: tuple = SEGMENT, other: tuple = SEGMENT, eps: float = 0.0) -> Column:
    """The point in which two of them cross; null if parallel or apart."""
    r, q = v.sub(s["end"], s["start"]), v.sub(o["end"], o["start"])
    w, d = v.sub(o["start"], s["start"]), v.cross(v.sub(s["end"], s["start"]), v.sub(o["end"], o["start"]))
    t, u = F.try_divide(v.cross(w, q), d), F.try_divide(v.cross(w, r), d)
    return F.when(_in(t, kind, eps) & _in(u, other, eps), v.lerp(s["start"], s["end"], t))


def intersects(s: Column, o: Column, eps: float = 1e-9) -> Column:
    """Whether two segments meet, collinear overlap included."""
    r, q, w = v.sub(s["end"], s["start"]), v.sub(o["end"], o["start"]), v.sub(o["start"], s["start"])
    d, rr = v.cross(r, q), v.dot(r, r)
    t0 = F.try_divide(v.dot(w, r), rr)
    t1 = t0 + F.try_divide(v.dot(q, r), rr)
    overlap = (F.abs(v.cross(w, r)) <= eps) & F.coalesce((F.greatest(t0, t1) >= -eps) & (F.least(t0, t1) <= 1 + eps), F.lit(False))
    t, u = F.try_divide(v.cross(w, q), d), F.try_divide(v.cross(w, r), d)
    return F.when(F.abs(d) <= eps, overlap).otherwise(_in(t, SEGMENT, eps) & _in(u, SEGMENT, eps))


def nearest_parameter(s: Column, p: Column) -> Column:
    d = v.sub(s["end"], s["start"])
    t = F.coalesce(F.try_divide(v.dot(v.sub(p, s["start"]), d), v.dot(d, d)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def distance_to_point(s: Column, p: Column) -> Column:
    return v.distance(p, v.lerp(s["start"], s["end"], nearest_parameter(s, p)))


def distance(s: Column, o: Column) -> Column:
    """Between two segments; zero if they meet."""
    ends = F.least(distance_to_point(s, o["start"]), distance_to_point(s, o["end"]), distance_to_point(o, s["start"]), distance_to_point(o, s["end"]))
    return F.when(intersects(s, o), F.lit(0.0)).otherwise(ends)


def distance_to_line(s: Column, p: Column) -> Column:
    """To the infinite line through the segment; null if its ends agree."""
    return F.try_divide(F.abs(v.cross(v.sub(s["end"], s["start"]), v.sub(p, s["start"]))), length(s))


def near_line(s: Column, p: Column, deviation: float = 4) -> Column:
    return distance_to_line(s, p) <= deviation


def contains_point(s: Column, p: Column, eps: float = 1e-10) -> Column:
    d, f = v.sub(s["end"], s["start"]), v.sub(p, s["start"])
    return (F.abs(v.cross(d, f)) <= eps) & (v.dot(f, d) >= -eps) & (v.dot(f, d) <= v.dot(d, d) + eps)


def point_at_distance(s: Column, d: Column | float) -> Column:
    """The point at distance d from the start towards the end; null if they agree."""
    return F.when(length(s) > 0, v.add(s["start"], v.scale(unit_vector(s), d)))


def perpendicular_point(s: Column, p: Column, d: Column | float) -> Column:
    """The foot of p on the line, moved by d across it (to the left of its direction)."""
    line, u = v.sub(s["end"], s["start"]), unit_vector(s)
    foot = v.lerp(s["start"], s["end"], F.try_divide(v.dot(v.sub(p, s["start"]), line), v.dot(line, line)))
    return F.when(length(s) > 0, v.add(foot, v.scale(v.point(-u["y"], u["x"]), d)))


def clip(s: Column, r: Column) -> Column:
    """The part of a segment in a closed box (Liang-Barsky); null if there is none."""
    d = v.sub(s["end"], s["start"])
    low, high, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for axis in "xy":
        near = F.try_divide(r[f"{axis}min"] - s["start"][axis], d[axis])
        far = F.try_divide(r[f"{axis}max"] - s["start"][axis], d[axis])
        low.append(F.least(near, far))
        high.append(F.greatest(near, far))
        out |= (d[axis] == 0) & ((s["start"][axis] < r[f"{axis}min"]) | (s["start"][axis] > r[f"{axis}max"]))
    t0, t1 = F.greatest(*low), F.least(*high)
    return F.when(~out & (t0 <= t1), segment(v.lerp(s["start"], s["end"], t0), v.lerp(s["start"], s["end"], t1)))
