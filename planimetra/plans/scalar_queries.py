"""Queries over scalar functions: angles, vectors, boxes, shapes and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angle, bezier, circle, lines, polygon, sector, shape
from ..functions import rect as rc
from ..functions import vector as v
from ..sources import tables as tb
from .registry import query, r4

_S = f"with {tb.SHAPES_SQL}"
a, b, c, d, e, f, g, h, i, j = "abcdefghij"


def _rows(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return tb.shapes(spark, sf_dir).select("id", *(x.alias(n) for n, x in columns.items()))


def _sql(ctes: str = "", source: str = "s", **columns: str) -> str:
    return f"{_S}{ctes} select id, " + ", ".join(f"{x} as {n}" for n, x in columns.items()) + f" from {source}"


def _r(x: str) -> str:
    return f"round({x}, 4) + 0"


_PM = "(({0}) - floor(({0}) / (2 * pi())) * 2 * pi())"


@query(_sql(normal=_r(f"case when a - b between 0 and 2 * pi() then a - b else {_PM.format('a - b')} end"), turned=_r(f"e + ({_PM.format('g - e + pi()')} - pi()) * 0.25::double"), deg=_r("degrees(e)"), rad=_r("radians(d)"), vx=_r("c * cos(e)"), vy=_r("c * sin(e)"), s=_r("sin(e)"), co=_r("cos(e)"), ta=_r("tan(g)"), less="e < g", zero="abs(j) <= 1e-9"))
def angle_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = {n: F.col(n) for n in "abcdefghij"}
    vec = angle.to_vector(x["e"], x["c"])
    return _rows(spark, sf_dir, normal=r4(angle.normalized(x["a"] - x["b"])), turned=r4(angle.lerp(x["e"], x["g"], 0.25)), deg=r4(F.degrees("e")), rad=r4(F.radians("d")), vx=r4(vec["x"]), vy=r4(vec["y"]), s=r4(F.sin("e")), co=r4(F.cos("e")), ta=r4(F.tan("g")), less=x["e"] < x["g"], zero=angle.is_zero(x["j"]))


@query(_sql(cr=_r("a * d - b * c"), dt=_r("a * c + b * d"), dist=_r("sqrt((a - c) * (a - c) + (b - d) * (b - d))"), d2=_r("(a - c) * (a - c) + (b - d) * (b - d)"), ang=_r("case when atan2(b - d, a - c) < 0 then atan2(b - d, a - c) + 2 * pi() else atan2(b - d, a - c) end"), mx=_r("(a + c) / 2"), my=_r("(b + d) / 2"), ix=_r("-a"), ax=_r("abs(a - c)"), tx=_r("a + 1.5::double"), eq="abs(a - c) <= 1e-6 and abs(b - d) <= 1e-6"))
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = v.point(a, b), v.point(c, d)
    return _rows(spark, sf_dir, cr=r4(v.cross(p, q)), dt=r4(v.dot(p, q)), dist=r4(v.distance(p, q)), d2=r4(v.distance2(p, q)), ang=r4(v.angle_of(p, q)), mx=r4(v.midpoint(p, q)["x"]), my=r4(v.midpoint(p, q)["y"]), ix=r4(v.invert(p)["x"]), ax=r4(v.absolute(v.sub(p, q))["x"]), tx=r4(v.translate(p, 1.5, 0)["x"]), eq=v.equal(p, q))


@query(_sql(rx=_r("c + (a - c) * cos(e) - (b - d) * sin(e)"), ry=_r("d + (a - c) * sin(e) + (b - d) * cos(e)"), sx=_r("2 * (c + (f - c) * t) - a"), sy=_r("2 * (d + (h - d) * t) - b"), cx=_r("a + c * cos(e)"), cy=_r("b + c * sin(e)"), segs="least(greatest(ceil(2 * pi() / (2 * acos(greatest(-1, 1 - 0.1::double / i)))), 8), 100)::int", source="(select *, ((a - c) * (f - c) + (b - d) * (h - d)) / ((f - c) * (f - c) + (h - d) * (h - d)) as t from s where i > 0.01 and abs(f - c) > 0.01)"))
def vector_rotation_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, s = v.point(a, b), v.point(c, d), v.point(f, h)
    turned, mirrored, on = v.rotate(p, F.col("e"), q), v.mirror(p, q, s), v.circle_point(F.col("c"), F.col("e"), p)
    rows = tb.shapes(spark, sf_dir).where("i > 0.01 and abs(f - c) > 0.01")
    return rows.select("id", r4(turned["x"]).alias("rx"), r4(turned["y"]).alias("ry"), r4(mirrored["x"]).alias("sx"), r4(mirrored["y"]).alias("sy"), r4(on["x"]).alias("cx"), r4(on["y"]).alias("cy"), v.circle_segments(F.col("i")).alias("segs"))


@query(_sql(inside="c >= least(a, f) and c <= greatest(a, f) and d >= least(b, h) and d <= greatest(b, h)", half="c >= least(a, f) and c < greatest(a, f) and d >= least(b, h) and d < greatest(b, h)", area=_r("abs(a - f) * abs(b - h)"), cx=_r("(least(a, f) + greatest(a, f)) / 2"), cy=_r("(least(b, h) + greatest(b, h)) / 2"), dx=_r("least(a, f) + 0.5::double"), dy=_r("greatest(b, h) - 0.25::double")))
def rect_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = lines.bbox(lines.segment(v.point(a, b), v.point(f, h))), v.point(c, d)
    small = rc.deflate(r, 0.5, 0.25)
    return _rows(spark, sf_dir, inside=rc.contains_point(r, p), half=rc.contains_point(r, p, closed=False), area=r4(rc.area(r)), cx=r4(rc.center(r)["x"]), cy=r4(rc.center(r)["y"]), dx=r4(small["xmin"]), dy=r4(small["ymax"]))


@query(f"{_S} select (id % 7)::bigint as k, round(min(a), 4) + 0 as xmin, round(min(b), 4) + 0 as ymin, round(max(a), 4) + 0 as xmax, round(max(b), 4) + 0 as ymax from s group by 1")
def point_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.shapes(spark, sf_dir).groupBy((F.col("id") % 7).alias("k")).agg(rc.bounds(v.point(a, b)).alias("r"))
    return rows.select("k", *(r4(F.col(f"r.{n}")).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))


_SEG = ", q as (select *, (d - b) as ry, (c - a) as rx, (h - f) as qy, (g + 5 - e) as qx, e - a as wx, f - b as wy from s), w as (select *, rx * qy - ry * qx as det from q), t as (select *, (wx * qy - wy * qx) / nullif(det, 0) as t, (wx * ry - wy * rx) / nullif(det, 0) as u from w)"


def _segments() -> tuple[Column, Column]:
    return lines.segment(v.point(a, b), v.point(c, d)), lines.segment(v.point(e, f), v.point(F.col("g") + 5, F.col("h")))


@query(_sql(_SEG, "t", px="case when t between 0 and 1 and u between 0 and 1 then round(a + rx * t, 4) + 0 end", py="case when t between 0 and 1 and u between 0 and 1 then round(b + ry * t, 4) + 0 end", meets="coalesce(abs(det) > 1e-9 and t between -1e-9 and 1 + 1e-9 and u between -1e-9 and 1 + 1e-9, false)", ray_x="case when t >= 0 and u >= 0 then round(a + rx * t, 3) + 0 end"))
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = _segments()
    p = lines.cross_point(s, o)
    return _rows(spark, sf_dir, px=r4(p["x"]), py=r4(p["y"]), meets=lines.intersects(s, o), ray_x=F.round(lines.cross_point(s, o, lines.RAY, lines.RAY)["x"], 3) + F.lit(0.0))


_PSD = "sqrt(pow(({x}) - ({x0}) - greatest(0, least(1, ((({x}) - ({x0})) * (({x1}) - ({x0})) + (({y}) - ({y0})) * (({y1}) - ({y0}))) / (pow(({x1}) - ({x0}), 2) + pow(({y1}) - ({y0}), 2)))) * (({x1}) - ({x0})), 2) + pow(({y}) - ({y0}) - greatest(0, least(1, ((({x}) - ({x0})) * (({x1}) - ({x0})) + (({y}) - ({y0})) * (({y1}) - ({y0}))) / (pow(({x1}) - ({x0}), 2) + pow(({y1}) - ({y0}), 2)))) * (({y1}) - ({y0})), 2))"


def _psd(x: str, y: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return _PSD.format(x=x, y=y, x0=x0, y0=y0, x1=x1, y1=y1)


_FIRST, _SECOND = ("a", "b", "c", "d"), ("e", "f", "g + 5", "h")
_SSD = "least(" + ", ".join((_psd("e", "f", *_FIRST), _psd("g + 5", "h", *_FIRST), _psd("a", "b", *_SECOND), _psd("c", "d", *_SECOND))) + ")"


@query(_sql(_SEG, "t", to_point=_r(_psd("e", "f", *_FIRST)), apart=f"case when coalesce(abs(det) > 1e-9 and t between -1e-9 and 1 + 1e-9 and u between -1e-9 and 1 + 1e-9, false) then 0 else round({_SSD}, 4) + 0 end", to_line=_r("abs(rx * wy - ry * wx) / sqrt(rx * rx + ry * ry)"), len=_r("sqrt(rx * rx + ry * ry)"), ahead=_r("a + rx / sqrt(rx * rx + ry * ry) * 2.5::double"), ux=_r("rx / sqrt(rx * rx + ry * ry)")))
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = _segments()
    p = v.point(e, f)
    return _rows(spark, sf_dir, to_point=r4(lines.distance_to_point(s, p)), apart=r4(lines.distance(s, o)), to_line=r4(lines.distance_to_line(s, p)), len=r4(lines.length(s)), ahead=r4(lines.point_at_distance(s, 2.5)["x"]), ux=r4(lines.unit_vector(s)["x"]))


_CC = "sqrt((a - c) * (a - c) + (b - d) * (b - d))"


@query(_sql(area=_r("pi() * e * e"), len=_r("2 * pi() * e"), bound=f"{_CC} >= abs(e - f) and {_CC} <= e + f", filled=f"{_CC} <= e + f", apart=_r(f"greatest(0, {_CC} - e - f)"), holds=f"{_CC} * {_CC} <= e * e", to_point=_r(f"greatest(0, {_CC} - e)"), box="pow(greatest(c - a, 0, a - c - 2), 2) + pow(greatest(d - b, 0, b - d - 3), 2) <= e * e"))
def circle_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = circle.circle(a, b, e), circle.circle(c, d, f)
    p, r = v.point(c, d), rc.rect(c, d, F.col("c") + 2, F.col("d") + 3)
    return _rows(spark, sf_dir, area=r4(circle.area(k)), len=r4(circle.length(k)), bound=circle.boundary_intersects(k, o), filled=circle.overlaps(k, o), apart=r4(circle.distance(k, o)), holds=circle.contains_point(k, p, eps=0.0), to_point=r4(circle.distance_to_point(k, p)), box=circle.overlaps_rect(k, r))


_CCP = f", q as (select *, {_CC} as dd from s), w as (select *, (e * e - f * f + dd * dd) / (2 * nullif(dd, 0)) as m from q), y as (select *, sqrt(greatest(0, e * e - m * m)) as hh from w)"


@query(_sql(_CCP, "y", n="case when dd = 0 then null when dd > e + f or dd < abs(e - f) then 0 else 2 end::int", x1="case when dd > 0 and dd <= e + f and dd >= abs(e - f) then round(a + m * (c - a) / dd - hh * (d - b) / dd, 3) + 0 end", y1="case when dd > 0 and dd <= e + f and dd >= abs(e - f) then round(b + m * (d - b) / dd + hh * (c - a) / dd, 3) + 0 end"))
def circle_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = circle.cross_points(circle.circle(a, b, e), circle.circle(c, d, f))
    first = F.try_element_at(found, F.lit(1))
    return _rows(spark, sf_dir, n=F.when(found.isNotNull(), F.size(found)), x1=F.round(first["x"], 3) + F.lit(0.0), y1=F.round(first["y"], 3) + F.lit(0.0))


_SC = ", q as (select *, c - a as dx, d - b as dy, a - f as fx, b - g as fy from s), w as (select *, dx * dx + dy * dy as qa, 2 * (fx * dx + fy * dy) as qb, fx * fx + fy * fy - e * e as qc from q), y as (select *, qb * qb - 4 * qa * qc as disc from w), t as (select *, (-qb - sqrt(greatest(disc, 0))) / (2 * qa) as t1, (-qb + sqrt(greatest(disc, 0))) / (2 * qa) as t2 from y)"


@query(_sql(_SC, "t", n="(case when disc >= 0 and t1 between 0 and 1 then 1 else 0 end + case when disc >= 0 and t2 between 0 and 1 then 1 else 0 end)::int", x1="case when disc >= 0 and t1 between 0 and 1 then round(a + dx * t1, 3) + 0 when disc >= 0 and t2 between 0 and 1 then round(a + dx * t2, 3) + 0 end"))
def segment_circle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = circle.segment_cross_points(circle.circle(f, g, e), lines.segment(v.point(a, b), v.point(c, d)))
    return _rows(spark, sf_dir, n=F.size(found), x1=F.round(F.try_element_at(found, F.lit(1))["x"], 3) + F.lit(0.0))


_TA = "abs(a * (d - f) + c * (f - b) + e * (b - d)) / 2"
_SIGN = [f"(({x1}) - ({x0})) * (h - ({y0})) - (({y1}) - ({y0})) * (g - ({x0}))" for x0, y0, x1, y1 in (("a", "b", "c", "d"), ("c", "d", "e", "f"), ("e", "f", "a", "b"))]


@query(_sql(area=_r(_TA), len=_r("sqrt(pow(a - c, 2) + pow(b - d, 2)) + sqrt(pow(c - e, 2) + pow(d - f, 2)) + sqrt(pow(e - a, 2) + pow(f - b, 2))"), cx=_r("(a + c + e) / 3"), cy=_r("(b + d + f) / 3"), inside="(" + " and ".join(f"{x} >= 0" for x in _SIGN) + ") or (" + " and ".join(f"{x} <= 0" for x in _SIGN) + ")"))
def triangle_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = polygon.triangle(v.point(a, b), v.point(c, d), v.point(e, f))
    p = polygon.vertices(t)
    center = v.scale(v.add(v.add(t["a"], t["b"]), t["c"]), 1 / 3)
    return _rows(spark, sf_dir, area=r4(polygon.area(p)), len=r4(polygon.length(p)), cx=r4(center["x"]), cy=r4(center["y"]), inside=polygon.triangle_contains_point(t, v.point(g, h), eps=0.0))


# a quadrilateral around (a, b) with half diagonals c + 1 and d + 1: convex, so areas and tests are short
def _kite() -> Column:
    x, y, p, q = F.col("a"), F.col("b"), F.col("c") + 1, F.col("d") + 1
    return F.array(v.point(x - p, y), v.point(x, y - q), v.point(x + p, y), v.point(x, y + q))


_KITE_IN = "abs({0} - a) / (c + 1) + abs({1} - b) / (d + 1) <= 1"


@query(_sql(area=_r("2 * (c + 1) * (d + 1)"), len=_r("4 * sqrt(pow(c + 1, 2) + pow(d + 1, 2))"), cx=_r("a"), cy=_r("b"), inside=_KITE_IN.format("e", "f"), box=" and ".join(_KITE_IN.format(x, y) for x, y in (("e", "f"), ("e + 1", "f"), ("e + 1", "f + 1"), ("e", "f + 1")))))
def polygon_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _kite()
    return _rows(spark, sf_dir, area=r4(polygon.area(p)), len=r4(polygon.length(p)), cx=r4(polygon.centroid(p)["x"]), cy=r4(polygon.centroid(p)["y"]), inside=polygon.contains_point(p, v.point(e, f)), box=polygon.contains_rect(p, rc.rect(e, f, F.col("e") + 1, F.col("f") + 1)))


_EDGES = (("a - c - 1", "b", "a", "b - d - 1"), ("a", "b - d - 1", "a + c + 1", "b"), ("a + c + 1", "b", "a", "b + d + 1"), ("a", "b + d + 1", "a - c - 1", "b"))
_KITE_D = f"case when {_KITE_IN.format('f', 'h')} then 0 else least(" + ", ".join(_psd("f", "h", *k) for k in _EDGES) + ") end"


@query(_sql(to_point=_r(_KITE_D), to_circle=_r(f"greatest(0, {_KITE_D} - e - 1)"), meets=f"({_KITE_D}) <= e + 1"))
def polygon_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _kite(), circle.circle(f, h, F.col("e") + 1)
    return _rows(spark, sf_dir, to_point=r4(polygon.distance_to_point(p, v.point(f, h))), to_circle=r4(polygon.distance_to_circle(p, k)), meets=polygon.overlaps_circle(p, k))


@query()
def polygon_hull_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = polygon.hull(F.array(v.point(a, b), v.point(c, d), v.point(e, f), v.point(g, h), v.point(i, j)))
    cut = polygon.clip_to_rect(_kite(), rc.rect(2, 2, 9, 9))
    rows = _rows(spark, sf_dir, p=p, cut=cut)
    return rows.select("id", F.size("p").alias("hull"), r4(polygon.area(F.col("p"))).alias("hull_area"), F.size("cut").alias("clipped"), r4(F.when(F.size("cut") > 2, polygon.area(F.col("cut"))).otherwise(0.0)).alias("clip_area"))


_ANG = "case when atan2(f - b, h - a) < 0 then atan2(f - b, h - a) + 2 * pi() else atan2(f - b, h - a) end"
_SD = "sqrt((h - a) * (h - a) + (f - b) * (f - b))"


@query(_sql(area=_r("(g + 1) * (pow(c + e + 1, 2) - c * c) / 2"), perimeter=_r("(c + c + e + 1) * (g + 1) + 2 * (e + 1)"), mx=_r("a + (c + c + e + 1) / 2 * cos(j + (g + 1) / 2)"), holds=f"{_SD} >= c and {_SD} <= c + e + 1 and {_PM.format(_ANG + ' - j')} <= g + 1", ends=_r("j + g + 1")))
def sector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sector.sector(a, b, c, F.col("c") + F.col("e") + 1, j, F.col("g") + 1)
    return _rows(spark, sf_dir, area=r4(sector.area(s)), perimeter=r4(sector.perimeter(s)), mx=r4(sector.centroid(s)["x"]), holds=sector.contains_point(s, v.point(h, f), eps=0.0), ends=r4(sector.end_angle(s)))


@query()
def sector_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sector.sector(a, b, c, F.col("c") + F.col("e") + 1, j, g)
    return _rows(spark, sf_dir, circle=sector.overlaps_circle(s, circle.circle(d, f, e)), rect=sector.overlaps_rect(s, rc.rect(d, f, F.col("d") + 2, F.col("f") + 2)), segment=sector.overlaps_segment(s, lines.segment(v.point(d, f), v.point(f, d))), kite=sector.overlaps_polygon(s, _kite()))


_CLIP = ", q as (select *, c - a as dx, d - b as dy from s where c <> a and d <> b), w as (select *, greatest(0, least((3 - a) / dx, (9 - a) / dx), least((2 - b) / dy, (8 - b) / dy)) as t0, least(1, greatest((3 - a) / dx, (9 - a) / dx), greatest((2 - b) / dy, (8 - b) / dy)) as t1 from q)"


@query(_sql(_CLIP, "w", x0="case when t0 <= t1 then round(a + dx * t0, 4) + 0 end", y1="case when t0 <= t1 then round(b + dy * t1, 4) + 0 end"))
def segment_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines.clip(lines.segment(v.point(a, b), v.point(c, d)), rc.rect(3, 2, 9, 8))
    return tb.shapes(spark, sf_dir).where("c <> a and d <> b").select("id", r4(s["start"]["x"]).alias("x0"), r4(s["end"]["y"]).alias("y1"))


_BZ = "pow(1 - {t}, 3) * a + 3 * pow(1 - {t}, 2) * {t} * c + 3 * (1 - {t}) * pow({t}, 2) * e + pow({t}, 3) * g"


def _bezier() -> Column:
    return bezier.curve(v.point(a, b), v.point(c, d), v.point(e, f), v.point(g, h))


@query(_sql(x25=_r(_BZ.format(t="0.25::double")), x50=_r(_BZ.format(t="0.5::double")), mid=_r("(a + 3 * c + 3 * e + g) / 8"), left_c2=_r("(a + 2 * c + e) / 4"), apart=_r("sqrt(pow(a - g, 2) + pow(b - h, 2)) * 2 + sqrt(pow(c - e, 2) + pow(d - f, 2)) * 2"), lx=_r("a + (g - a) * 0.3::double")))
def bezier_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _bezier()
    left, right = bezier.split(k, 0.5)
    return _rows(spark, sf_dir, x25=r4(bezier.point_at(k, 0.25)["x"]), x50=r4(bezier.point_at(k, 0.5)["x"]), mid=r4(right["p0"]["x"]), left_c2=r4(left["c2"]["x"]), apart=r4(bezier.similarity(k, bezier.reversed_curve(k))), lx=r4(bezier.lerp(k, bezier.reversed_curve(k), 0.3)["p0"]["x"]))


@query()
def bezier_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _bezier()
    box, half = bezier.bbox(k), bezier.point_at_length(k, bezier.length(k) / 2)
    return _rows(spark, sf_dir, length=r4(bezier.length(k)), hx=r4(half["x"]), hy=r4(half["y"]), xmin=r4(box["xmin"]), xmax=r4(box["xmax"]), pieces=F.size(bezier.split_parts(k, 4)), near=bezier.contains(k, v.point(c, d)))


@query()
def bezier_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parameters that cut each curve in equal lengths, and the unit tangent at a length of 5."""
    k = _bezier()
    return _rows(spark, sf_dir, ts=F.transform(bezier.even_ts(k, 4), lambda t: F.round(t, 9)), tangent=bezier.tangent_at_length(k, 5.0))


@query(_sql(arc="greatest(1, ceil(abs(g) / (pi() / 2)))::int", ax=_r("a + (c + 1) * cos(e) - (c + 1) * 4 / 3 * tan(g / greatest(1, ceil(abs(g) / (pi() / 2))) / 4) * sin(e)"), oval=_r("b + 1.5 + 1.5 * 0.5522847498"), round="8"))
def bezier_factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = bezier.of_arc(v.point(a, b), F.col("c") + 1, F.col("e"), F.col("g"))
    r = rc.rect(a, b, F.col("a") + 4, F.col("b") + 3)
    return _rows(spark, sf_dir, arc=F.size(arc), ax=r4(arc[0]["c1"]["x"]), oval=r4(bezier.of_oval(r)[0]["c1"]["y"]), round=F.size(bezier.of_rounded_rect(r, 0.5)))


def _near(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """SQL of the distance of a point from a segment."""
    t = f"greatest(0, least(1, coalesce((({px} - ({ax})) * ({bx} - ({ax})) + ({py} - ({ay})) * ({by} - ({ay}))) / nullif(pow({bx} - ({ax}), 2) + pow({by} - ({ay}), 2), 0), 0)))"
    return f"sqrt(pow({px} - ({ax} + ({bx} - ({ax})) * {t}), 2) + pow({py} - ({ay} + ({by} - ({ay})) * {t}), 2))"


_KITE = [("a - c - 1", "b"), ("a", "b - d - 1"), ("a + c + 1", "b"), ("a", "b + d + 1")]
_IN_KITE = "abs({0} - a) / (c + 1) + abs({1} - b) / (d + 1) <= 1"
_TO_KITE = "case when " + _IN_KITE.format("d", "f") + " then 0 else least(" + ", ".join(_near("d", "f", *p, *q) for p, q in zip(_KITE, _KITE[1:] + _KITE[:1], strict=True)) + ") end"
_GAP = f"greatest(0, case id % 3 when 0 then {_near('d', 'f', 'a', 'b', 'c', 'd')} when 1 then sqrt(pow(a - d, 2) + pow(b - f, 2)) - (e + 1) else {_TO_KITE} end - (g + 1))"


@query(_sql(overlap=f"{_GAP} <= 0", gap=_r(_GAP), holds=f"case id % 3 when 0 then false when 1 then pow(a - h, 2) + pow(b - j, 2) <= pow(e + 1, 2) else {_IN_KITE.format('h', 'j')} end"))
def shape_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, circles and kites in one column, against circles."""
    x = F.when(F.col("id") % 3 == 0, shape.shape("segment", lines.segment(v.point(a, b), v.point(c, d)))).when(F.col("id") % 3 == 1, shape.shape("circle", circle.circle(a, b, F.col("e") + 1))).otherwise(shape.shape("polygon", _kite()))
    y, kinds = shape.shape("circle", circle.circle(d, f, F.col("g") + 1)), ("segment", "circle", "polygon")
    return _rows(spark, sf_dir, overlap=shape.overlaps(y, x, ("circle",), kinds), gap=r4(shape.distance(x, y, kinds, ("circle",))), holds=shape.contains_point(x, v.point(h, j)))


_LINE = "abs((c - a) * (f - b) - (d - b) * (e - a)) / nullif(sqrt(pow(c - a, 2) + pow(d - b, 2)), 0)"
_FOOT = "((e - a) * (c - a) + (f - b) * (d - b)) / nullif(pow(c - a, 2) + pow(d - b, 2), 0)"


@query(_sql(full="abs(e - 2 * pi()) <= 1e-9", same="abs(a - b) <= 1e-10", near=f"{_LINE} <= 4", name="printf('[%.2f,%.2f,%.2f,%.2f]', least(a, c), least(b, d), greatest(a, c), greatest(b, d))", boxed="a - c - 1 >= -20 and b - d - 1 >= -20 and a + c + 1 <= 20 and b + d + 1 <= 20", foot=_r(f"a + (c - a) * {_FOOT} - 2 * (d - b) / nullif(sqrt(pow(c - a, 2) + pow(d - b, 2)), 0)"), quad=_r("g + (h - g) * 0.666667::double"), flat="abs((c - a) * (f - b) - (d - b) * (e - a)) <= 1e-9 and abs((c - a) * (j - b) - (d - b) * (i - a)) <= 1e-9", apart=_r(f"greatest(0, {_near('e', 'f', 'a', 'b', 'c', 'd')} - j)"), path=f"least({_near('i', 'j', 'a', 'b', 'c', 'd')}, {_near('i', 'j', 'c', 'd', 'e', 'f')}) <= 2", middle=_r("c + e / 2"), empty="abs(e) <= 1e-9 or b - a <= 1e-9", alike=_r("abs(c - a) + abs(d - b)")))
def scalar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller predicates and constructions that no other query calls."""
    x = {n: F.col(n) for n in "abcdefghij"}
    s, p = lines.segment(v.point(a, b), v.point(c, d)), v.point(e, f)
    k, arc = bezier.curve(v.point(a, b), p, v.point(i, j), v.point(c, d)), sector.sector(a, b, a, b, c, e)
    flat, raised = bezier.of_line(v.point(a, b), v.point(a, b)), bezier.curve(v.point(c, b), v.point(a, d), v.point(a, b), v.point(a, b))
    chain = F.array(v.point(a, b), v.point(c, d), p)
    return _rows(spark, sf_dir, full=angle.is_full(x["e"]), same=angle.equals(x["a"], x["b"]), near=lines.near_line(s, p), name=rc.to_string(lines.bbox(s)), boxed=rc.contains_polygon(rc.rect(-20, -20, 20, 20), _kite()), foot=r4(lines.perpendicular_point(s, p, 2.0)["x"]), quad=r4(bezier.of_quadratic(v.point(g, b), v.point(h, d), p)["c1"]["x"]), flat=bezier.is_line(k), apart=r4(circle.distance_to_segment(circle.circle(e, f, j), s)), path=polygon.near_polyline(chain, v.point(i, j)), middle=r4(sector.center_angle(arc)), empty=sector.is_empty(arc), alike=r4(bezier.similarity(flat, raised)))


@query(f"{_S} select (id % 7)::bigint as k, round(min(least(a, c)), 4) + 0 as xmin, round(min(least(b, d)), 4) + 0 as ymin, round(max(greatest(a, c)), 4) + 0 as xmax, round(max(greatest(b, d)), 4) + 0 as ymax from s group by 1")
def rect_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.shapes(spark, sf_dir).select((F.col("id") % 7).alias("k"), lines.bbox(lines.segment(v.point(a, b), v.point(c, d))).alias("box"))
    rows = rows.groupBy("k").agg(rc.bounds_of_rects(F.col("box")).alias("r"))
    return rows.select("k", *(r4(F.col(f"r.{n}")).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))
