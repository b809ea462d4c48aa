"""Points and vectors: struct<x: double, y: double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angle import TWO_PI, normalized


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def point(x: Column | str | float, y: Column | str | float) -> Column:
    x, y = (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def add(p: Column, q: Column) -> Column:
    return point(p["x"] + q["x"], p["y"] + q["y"])


def sub(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def scale(p: Column, k: Column | float) -> Column:
    return point(p["x"] * k, p["y"] * k)


def invert(p: Column) -> Column:
    return point(-p["x"], -p["y"])


def absolute(p: Column) -> Column:
    return point(F.abs(p["x"]), F.abs(p["y"]))


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - p["y"] * q["x"]


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"]


def distance2(p: Column, q: Column) -> Column:
    """The squared distance."""
    return (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(distance2(p, q))


def angle_of(p: Column, center: Column | None = None) -> Column:
    """The direction of p seen from center (default: origin), in [0, 2 pi)."""
    a = F.atan2(p["y"] - center["y"], p["x"] - center["x"]) if center is not None else F.atan2(p["y"], p["x"])
    return F.when(a < 0, a + TWO_PI).otherwise(a)


def rotate(p: Column, angle: Column, center: Column | None = None) -> Column:
    c = center if center is not None else point(0.0, 0.0)
    a, d = normalized(angle), sub(p, c)
    return point(c["x"] + d["x"] * F.cos(a) - d["y"] * F.sin(a), c["y"] + d["x"] * F.sin(a) + d["y"] * F.cos(a))


def translate(p: Column, dx: Column | float, dy: Column | float) -> Column:
    return point(p["x"] + dx, p["y"] + dy)


def midpoint(p: Column, q: Column) -> Column:
    return point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)


def lerp(p: Column, q: Column, t: Column | float) -> Column:
    return point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)


def mirror(p: Column, a: Column, b: Column) -> Column:
    """p mirrored at the line through a and b; null if a = b."""
    d, f = sub(b, a), sub(p, a)
    t = F.try_divide(dot(f, d), dot(d, d))
    return F.when(t.isNotNull(), point(2 * (a["x"] + d["x"] * t) - p["x"], 2 * (a["y"] + d["y"] * t) - p["y"]))


def equal(p: Column, q: Column, eps: float = 1e-6) -> Column:
    return (F.abs(p["x"] - q["x"]) <= eps) & (F.abs(p["y"] - q["y"]) <= eps)


def unit(p: Column) -> Column:
    """p with length one; the zero vector stays."""
    n = F.sqrt(dot(p, p))
    return point(F.coalesce(F.try_divide(p["x"], n), F.lit(0.0)), F.coalesce(F.try_divide(p["y"], n), F.lit(0.0)))


def circle_point(radius: Column | float, angle: Column, center: Column | None = None) -> Column:
    c = center if center is not None else point(0.0, 0.0)
    return point(c["x"] + radius * F.cos(angle), c["y"] + radius * F.sin(angle))


def circle_segments(radius: Column, max_error: float = 0.1) -> Column:
    """Chords that keep within max_error of a circle, 8 to 100."""
    bounded = F.greatest(F.lit(-1.0), F.lit(1.0) - F.try_divide(F.lit(max_error), radius))
    n = F.ceil(F.try_divide(F.lit(TWO_PI), 2 * F.acos(bounded)))
    return F.when(radius <= 0, F.lit(8)).otherwise(F.least(F.greatest(n, F.lit(8)), F.lit(100))).cast("int")
