"""Angles in radians as plain columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI, HALF_PI = 2 * math.pi, math.pi / 2


def normalized(a: Column) -> Column:
    """Into [0, 2 pi]; both ends are kept as they are."""
    return F.when(a.between(0.0, TWO_PI), a).otherwise(F.pmod(a, F.lit(TWO_PI)))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    """From a to b along the shorter arc."""
    return a + (F.pmod(b - a + math.pi, F.lit(TWO_PI)) - math.pi) * t


def to_vector(a: Column, length: Column | float) -> Column:
    return F.struct((length * F.cos(a)).alias("x"), (length * F.sin(a)).alias("y"))


def is_zero(a: Column, eps: float = 1e-9) -> Column:
    return F.abs(a) <= eps


def is_full(a: Column, eps: float = 1e-9) -> Column:
    return F.abs(a - TWO_PI) <= eps


def equals(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return F.abs(a - b) <= eps


def within(a: Column, start: Column, span: Column, eps: float = 1e-9) -> Column:
    """Whether a lies in the arc of `span` from start; a span of zero is a full turn."""
    full = F.when(F.abs(span) <= eps, F.lit(TWO_PI)).otherwise(span)
    from_start = F.pmod(a - start, F.lit(TWO_PI))
    return (from_start <= full + eps) | (from_start >= TWO_PI - eps)
