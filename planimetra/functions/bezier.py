"""Cubic Bezier curves: struct<p0, c1, c2, p3> columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vector as v
from .rect import rect

#: Handle length for a quarter of a unit circle (fixed value).
KAPPA = 0.5522847498
#: Chords of the arc-length table: three quarters of the length, within these.
FEWEST, MOST = 8, 1000
#: Parts that lengths are integrated in, and Newton's steps in one of them.
PIECES, STEPS = 16, 5
#: Places and weights of Gauss's rule on -1 to 1 (fixed values).
GAUSS = ((0.0, 128 / 225), (0.5384693101056831, 0.47862867049936647), (-0.5384693101056831, 0.47862867049936647), (0.9061798459386640, 0.23692688505618908), (-0.9061798459386640, 0.23692688505618908))


def curve(p0: Column, c1: Column, c2: Column, p3: Column) -> Column:
    return F.struct(p0.alias("p0"), c1.alias("c1"), c2.alias("c2"), p3.alias("p3"))


def of_line(a: Column, b: Column) -> Column:
    return curve(a, v.lerp(a, b, 1 / 3), v.lerp(a, b, 2 / 3), b)


def of_quadratic(a: Column, c: Column, b: Column) -> Column:
    return curve(a, v.lerp(a, c, 0.666667), v.lerp(b, c, 0.666667), b)


def point_at(b: Column, t: Column | float) -> Column:
    """The point at t; null outside 0 to 1."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    u = 1 - t
    at = lambda k: u * u * u * b["p0"][k] + 3 * u * u * t * b["c1"][k] + 3 * u * t * t * b["c2"][k] + t * t * t * b["p3"][k]
    return F.when(t.between(0.0, 1.0), v.point(at("x"), at("y")))


def tangent_at(b: Column, t: Column) -> Column:
    u = 1 - t
    at = lambda k: 3 * u * u * (b["c1"][k] - b["p0"][k]) + 6 * u * t * (b["c2"][k] - b["c1"][k]) + 3 * t * t * (b["p3"][k] - b["c2"][k])
    return v.point(at("x"), at("y"))


def split(b: Column, t: Column | float) -> tuple[Column, Column]:
    """The two parts of a curve cut at t (de Casteljau)."""
    ab, bc, cd = v.lerp(b["p0"], b["c1"], t), v.lerp(b["c1"], b["c2"], t), v.lerp(b["c2"], b["p3"], t)
    abc, bcd = v.lerp(ab, bc, t), v.lerp(bc, cd, t)
    mid = v.lerp(abc, bcd, t)
    return curve(b["p0"], ab, abc, mid), curve(mid, bcd, cd, b["p3"])


def part(b: Column, t0: Column, t1: Column) -> Column:
    """The part from t0 to t1, by its ends and tangents."""
    k, p, q = (t1 - t0) / 3, point_at(b, t0), point_at(b, t1)
    return curve(p, v.add(p, v.scale(tangent_at(b, t0), k)), v.sub(q, v.scale(tangent_at(b, t1), k)), q)


def split_parts(b: Column, n: int) -> Column:
    """n parts of equal t."""
    if n <= 0:
        raise ValueError("a curve has at least one part")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: part(b, i / F.lit(float(n)), (i + 1) / F.lit(float(n))))


def _table_size(b: Column) -> Column:
    control = v.distance(b["p0"], b["c1"]) + v.distance(b["c1"], b["c2"]) + v.distance(b["c2"], b["p3"])
    return F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.ceil(0.75 * control).cast("int")))


def _chords(b: Column) -> Column:
    points = _let(_table_size(b), lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: point_at(b, i / n.cast("double"))))
    return _let(points, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: v.distance(a, b)))


def lengths(b: Column) -> Column:
    """Running sums of the chords at equal steps of t, from 0 on: the arc-length table."""
    return F.aggregate(_chords(b), F.array(F.lit(0.0)), lambda sums, d: F.concat(sums, F.array(F.element_at(sums, -1) + d)))


def length(b: Column) -> Column:
    return F.aggregate(_chords(b), F.lit(0.0), lambda s, d: s + d)


_let = v.let


def t_at_length(b: Column, at: Column | float) -> Column:
    """The parameter at a length along the curve, between the table's entries; ends are clamped."""
    at = at if isinstance(at, Column) else F.lit(float(at))

    return _let(F.struct(lengths(b).alias("table"), at.alias("at")), lambda s: _t_in(s["table"], s["at"]))


def _t_in(table: Column, at: Column) -> Column:
    n, k = (F.size(table) - 1).cast("double"), F.size(F.filter(table, lambda x: x <= at))
    low = F.element_at(table, F.greatest(k, F.lit(1)))
    high = F.element_at(table, F.least(k + 1, F.size(table)))
    return F.when(at <= 0, F.lit(0.0)).when(k >= F.size(table), F.lit(1.0)).otherwise((k - 1 + F.coalesce(F.try_divide(at - low, high - low), F.lit(0.0))) / n)


def point_at_length(b: Column, at: Column | float) -> Column:
    return _let(t_at_length(b, at), lambda t: point_at(b, t))


def _ts(curves: pa.Array, share: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The parameters (row by row) at shares of each curve's length, or of given lengths. Ends are
    clamped; a curve without length or without a coordinate gives 0, one whose length is not finite 1.

    The speed is integrated in PIECES parts of equal t by Gauss's rule of five places; Newton's steps
    start from where these put the length and stay in their part.
    """
    ends = [pc.struct_field(curves, k) for k in ("p0", "c1", "c2", "p3")]
    null = np.zeros(len(curves), bool)
    for end in ends:
        for k in ("x", "y"):
            null |= pc.is_null(pc.struct_field(end, k)).to_numpy(zero_copy_only=False)
    places, weights = np.array(GAUSS).T
    coordinate = lambda end, k: pc.cast(pc.struct_field(end, k), pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        steps = [[coordinate(q, k) - coordinate(p, k) for p, q in zip(ends, ends[1:])] for k in ("x", "y")]

        def speed(t: np.ndarray) -> np.ndarray:
            u, total = 1 - t, 0.0
            for a, b, c in steps:
                a, b, c = (d.reshape(-1, *[1] * (t.ndim - 1)) for d in (a, b, c))
                total = total + (3 * u * u * a + 6 * u * t * b + 3 * t * t * c) ** 2
            return np.sqrt(total)

        def arc(t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
            mid, half = (t0 + t1) / 2, (t1 - t0) / 2
            return (speed(mid[..., None] + half[..., None] * places) * weights).sum(-1) * half

        grid = np.arange(PIECES + 1) / PIECES
        parts = arc(grid[None, :-1], grid[None, 1:])
        sums = np.concatenate([np.zeros((len(parts), 1)), np.cumsum(parts, 1)], 1)
        at = sums[:, -1:] * share if at is None else at[:, None] * share
        k = np.clip((sums[:, None, :] <= at[:, :, None]).sum(-1), 1, PIECES)
        low, before = (k - 1) / PIECES, np.take_along_axis(sums, k - 1, 1)
        rest, length = at - before, np.take_along_axis(sums, k, 1) - before
        t = low + np.divide(rest, length, out=np.zeros_like(rest), where=length != 0) / PIECES
        for _ in range(STEPS):
            now = speed(t)
            t = t - np.divide(arc(low, t) - rest, now, out=np.zeros_like(t), where=now != 0)
            t = np.clip(t, low, low + 1 / PIECES)
        t = np.where(at <= 0, 0.0, np.where((at >= sums[:, -1:]) | ~np.isfinite(sums[:, -1:]), 1.0, t))
    t[null] = 0.0
    return t


def _t_at(curves: pa.Array, at: pa.Array) -> pa.Array:
    lengths = pc.cast(at, pa.float64())
    t = _ts(curves, np.ones(1), lengths.to_numpy(zero_copy_only=False))
    return pa.array(np.where(lengths.is_null().to_numpy(zero_copy_only=False), 0.0, t[:, 0]))


def tangent_at_length(b: Column, at: Column | float) -> Column:
    """The unit tangent at a length along the curve, to within even_ts's precision."""
    at = at if isinstance(at, Column) else F.lit(float(at))
    t = F.arrow_udf(_t_at, "double")(b, at)
    return _let(F.struct(b.alias("b"), t.alias("t")), lambda c: _let(tangent_at(c["b"], c["t"]), v.unit))


def even_ts(b: Column, n: int) -> Column:
    """n + 1 parameters at equal distances along the curve; without turning points of no speed, the
    distances are equal to some 1e-5 of the length. Worked out for whole Arrow batches."""

    def work(curves: pa.Array) -> pa.Array:
        t = _ts(curves, np.arange(n + 1) / n)
        t[:, n] = 1.0
        return pa.ListArray.from_arrays(np.arange(len(t) + 1, dtype=np.int32) * (n + 1), pa.array(t.ravel()))

    return F.arrow_udf(work, "array<double>")(b)


def bbox(b: Column) -> Column:
    """The exact bounds: ends and the roots of the derivative."""
    def extent(k: str) -> tuple[Column, Column]:
        p0, p1, p2, p3 = (b[n][k] for n in ("p0", "c1", "c2", "p3"))
        a, h, c = -p0 + 3 * p1 - 3 * p2 + p3, 2 * (p0 - 2 * p1 + p2), p1 - p0
        disc = h * h - 4 * a * c
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        ts = F.array(F.lit(0.0), F.lit(1.0), F.try_divide(-h + root, 2 * a), F.try_divide(-h - root, 2 * a), F.try_divide(-c, h))
        ts = F.filter(ts, lambda t: t.between(0.0, 1.0) & ((disc >= 0) | t.isin(0.0, 1.0)))
        values = F.transform(ts, lambda t: point_at(b, t)[k])
        return F.array_min(values), F.array_max(values)

    (x0, x1), (y0, y1) = extent("x"), extent("y")
    return rect(x0, y0, x1, y1)


def is_line(b: Column, eps: float = 1e-9) -> Column:
    d = v.sub(b["p3"], b["p0"])
    return (F.abs(v.cross(d, v.sub(b["c1"], b["p0"]))) <= eps) & (F.abs(v.cross(d, v.sub(b["c2"], b["p0"]))) <= eps)


def reversed_curve(b: Column) -> Column:
    return curve(b["p3"], b["c2"], b["c1"], b["p0"])


def contains(b: Column, p: Column, samples: int = 100) -> Column:
    """Whether p is nearer than 2 to the curve, seen at evenly spaced parameters."""
    at = F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: v.distance2(point_at(b, i / F.lit(float(samples))), p))
    return F.array_min(at) < 4


def similarity(b: Column, c: Column) -> Column:
    """The sum of the distances of corresponding ends and handles."""
    total = v.distance(b["p0"], c["p0"])
    for k in ("c1", "c2", "p3"):
        total = total + v.distance(b[k], c[k])
    return total


def lerp(b: Column, c: Column, t: Column | float) -> Column:
    return curve(*(v.lerp(b[k], c[k], t) for k in ("p0", "c1", "c2", "p3")))


def of_arc(center: Column, radius: Column, start: Column, sweep: Column) -> Column:
    """An arc as curves of at most a quarter turn each."""
    n = F.greatest(F.lit(1), F.ceil(F.abs(sweep) / (math.pi / 2)).cast("int"))
    step = sweep / n
    handle = radius * 4 / 3 * F.tan(step / 4)

    def piece(i: Column) -> Column:
        a, b = start + step * i, start + step * (i + 1)
        p, q = v.circle_point(radius, a, center), v.circle_point(radius, b, center)
        return curve(p, v.point(p["x"] - handle * F.sin(a), p["y"] + handle * F.cos(a)), v.point(q["x"] + handle * F.sin(b), q["y"] - handle * F.cos(b)), q)

    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def of_oval(r: Column) -> Column:
    """The ellipse in a box as four curves, from its right end on."""
    cx, cy, rx, ry = (r["xmin"] + r["xmax"]) / 2, (r["ymin"] + r["ymax"]) / 2, (r["xmax"] - r["xmin"]) / 2, (r["ymax"] - r["ymin"]) / 2
    at = lambda x, y: v.point(cx + rx * x, cy + ry * y)
    k, turns = KAPPA, [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]
    return F.array(*(curve(at(*p), at(p[0] + k * q[0], p[1] + k * q[1]), at(q[0] + k * p[0], q[1] + k * p[1]), at(*q)) for p, q in zip(turns, turns[1:])))


def of_circle(c: Column) -> Column:
    return of_oval(rect(c["cx"] - c["r"], c["cy"] - c["r"], c["cx"] + c["r"], c["cy"] + c["r"]))


def of_rounded_rect(r: Column, radius: Column | float) -> Column:
    """A box with rounded corners: four corners and the lines between them."""
    rad = radius if isinstance(radius, Column) else F.lit(float(radius))
    xs, ys = (r["xmin"], r["xmax"]), (r["ymin"], r["ymax"])
    spots = [(xs[1], ys[0], -1, 0, 0, 1), (xs[1], ys[1], 0, -1, -1, 0), (xs[0], ys[1], 1, 0, 0, -1), (xs[0], ys[0], 0, 1, 1, 0)]
    ends, out = [], []
    for x, y, ax, ay, bx, by in spots:
        a, b = v.point(x + rad * ax, y + rad * ay), v.point(x + rad * bx, y + rad * by)
        out.append(curve(a, v.lerp(a, v.point(x, y), KAPPA), v.lerp(b, v.point(x, y), KAPPA), b))
        ends.append((a, b))
    return F.array(*out, *(of_line(ends[i][1], ends[(i + 1) % 4][0]) for i in range(4)))
