"""Queries over line styles and polylines of customers' orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rect as rc
from ..operators import curves, polyline
from ..sources import tables as tb
from .registry import ORACLES, QUERIES, query, r4

_P = f"with {tb.PATHS_SQL}"
_W = "window w as (partition by path_id order by ord)"


def _flat(df: DataFrame) -> DataFrame:
    """path_id, seg and the eight coordinates."""
    return df.select("path_id", F.col("seg").cast("long").alias("seg"), *(r4(F.col(f"curve.{p}.{a}")).alias(f"{p}{a}") for p in ("p0", "c1", "c2", "p3") for a in "xy"))


def _lerp(a: str, b: str, t: float) -> str:
    return f"(({a}) + (({b}) - ({a})) * {t}::double)"


#: Rows of each window kind as SQL: the first point of every segment has the columns x0..x3, y0..y3.
_PAIR = "(select path_id, ord - 1 as seg, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from p {w})".format(w=_W)
_CLAMP = "(select path_id, ord - 1 as seg, x as x1, y as y1, coalesce(lag(x) over w, x) as x0, coalesce(lag(y) over w, y) as y0, lead(x) over w as x2, lead(y) over w as y2, coalesce(lead(x, 2) over w, lead(x) over w) as x3, coalesce(lead(y, 2) over w, lead(y) over w) as y3 from p {w})".format(w=_W)
# a path of two or three points is padded to four: the first point twice, with two points the last one too
_PAD = "pad as (select path_id, x, y, row_number() over (partition by path_id order by pos) as ord from (select path_id, x, y, unnest(case when n < 4 and ord = 1 then [0.5, 1] when n = 2 and ord = 2 then [2, 2.5] else [ord] end) as pos from (select *, count(*) over (partition by path_id) as n from p) where n >= 2))"
_SLIDE = "(select path_id, ord - 1 as seg, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1, lead(x, 2) over w as x2, lead(y, 2) over w as y2, lead(x, 3) over w as x3, lead(y, 3) over w as y3 from pad {w})".format(w=_W)
_CLAMP_PAD = _CLAMP.replace("from p ", "from pad ")


def _style(name: str, source: str, x: tuple, keep: str, pad: bool | str = False):
    """Registers a style whose coordinates have one form for x and y; forms are written in x.
    pad: with _PAD, or with other tables that the source needs."""
    cols = []
    for part, form in zip(("p0", "c1", "c2", "p3"), x, strict=True):
        for axis in "xy":
            own = form if isinstance(form, str) else form["xy".index(axis)]
            own = own if axis == "x" or not isinstance(form, str) else own.replace("x", "y")
            cols.append(f"round({own}, 4) + 0 as {part}{axis}")
    sql = f"{_P}{', ' + (pad if isinstance(pad, str) else _PAD) if pad else ''} select path_id, seg, {', '.join(cols)} from {source} where {keep} is not null"

    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


K = 0.8


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.order_paths(spark, sf_dir)


def _add(name: str, source: str, x: tuple, keep: str, make, pad: bool | str = False) -> None:
    _style(name, source, x, keep, pad)(lambda spark, sf_dir: _flat(make(_paths(spark, sf_dir))))


_THIRD, _TWO = _lerp("x0", "x1", 1 / 3), _lerp("x0", "x1", 2 / 3)
_M12, _M23 = "(x1 + x2) / 2", "(x2 + x3) / 2"
_add("curve_normal", _PAIR, ("x0", _THIRD, _TWO, "x1"), "x1", curves.normal)
_add("curve_basis", _SLIDE, (_lerp(_M12, "(x0 + 2 * x1 + x2) / 4", K), _lerp(_M12, "(x0 + 4 * x1 + x2) / 6", K), _lerp(_M23, "(x1 + 4 * x2 + x3) / 6", K), _lerp(_M23, "(x1 + 2 * x2 + x3) / 4", K)), "x3", lambda p: curves.basis(p, K), pad=True)
_add("curve_basis_open", _SLIDE, (_lerp(_M12, "(x0 + 4 * x1 + x2) / 6", K),) * 2 + (_lerp(_M12, "(x1 + 4 * x2 + x3) / 6", K),) * 2, "x3", lambda p: curves.basis_open(p, K), pad=True)
_add("curve_bspline", _SLIDE, (_lerp(_M12, "(x0 + 4 * x1 + x2) / 6", K), _lerp(_M12, "(x0 + 6 * x1 + x2) / 8", K), _lerp(_M23, "(x1 + 6 * x2 + x3) / 8", K), _lerp(_M23, "(x1 + 4 * x2 + x3) / 6", K)), "x3", lambda p: curves.bspline(p, K), pad=True)
_add("curve_bump_x", _PAIR, ("x0", (_THIRD, _lerp(_THIRD.replace("x", "y"), "y0", K)), (_TWO, _lerp(_TWO.replace("x", "y"), "y1", K)), "x1"), "x1", lambda p: curves.bump(p, K, "x"))
_add("curve_bump_y", _PAIR, ("x0", (_lerp(_THIRD, "x0", K), _THIRD.replace("x", "y")), (_lerp(_TWO, "x1", K), _TWO.replace("x", "y")), "x1"), "x1", lambda p: curves.bump(p, K, "y"))
_add("curve_bundle", _CLAMP_PAD, ("x1", _lerp("x1 + (x2 - x0) / 6", _M12, 1 - K), _lerp("x2 - (x3 - x1) / 6", _M12, 1 - K), "x2"), "x2", lambda p: curves.bundle(p, K), pad=True)
_add("curve_bundle_alpha", _CLAMP_PAD, ("x1", _lerp("x1 + (x2 - x0) * 0.25::double", _M12, 1 - K), _lerp("x2 - (x3 - x1) * 0.25::double", _M12, 1 - K), "x2"), "x2", lambda p: curves.bundle(p, K, 0.25), pad=True)
_add("curve_cardinal", _CLAMP, ("x1", f"x1 + (x2 - x0) * {K}::double / 6", f"x2 - (x3 - x1) * {K}::double / 6", "x2"), "x2", lambda p: curves.cardinal(p, K))
_add("curve_cardinal_open", _CLAMP, ("x1", f"x1 + (x2 - x0) * {K}::double / 2", f"x2 - (x3 - x1) * {K}::double / 2", "x2"), "x2", lambda p: curves.cardinal_open(p, K))
_add("curve_cardinal_tension", _CLAMP, ("x1", f"x1 + (x2 - x0) * {K}::double / 2", f"x2 - (x3 - x1) * {K}::double / 2", "x2"), "x2", lambda p: curves.cardinal_tension(p, K))
_add("curve_catmull_rom_open", _CLAMP, ("x1", f"x1 + (x2 - x0) * {K}::double / 2", f"x2 - (x3 - x1) * {K}::double / 2", "x2"), "x2", lambda p: curves.catmull_rom_open(p, K))
_D = {n: f"sqrt(pow(x{a} - x{b}, 2) + pow(y{a} - y{b}, 2))" for n, a, b in ((1, 0, 1), (2, 1, 2), (3, 2, 3))}
_CR = tuple(tuple(f"{axis}{p} {sign} ({axis}{q} - {axis}{r}) * {K}::double * ({_D[m]}) / nullif(({_D[m]}) + ({_D[n]}), 0) / 3" for axis in "xy") for p, sign, q, r, m, n in ((1, "+", 2, 0, 1, 2), (2, "-", 3, 1, 2, 3)))
_add("curve_catmull_rom", _CLAMP, ("x1", *(tuple(f"coalesce({z}, {axis}{p})" for z, axis in zip(form, "xy", strict=True)) for form, p in zip(_CR, (1, 2), strict=True)), "x2"), "x2", lambda p: curves.catmull_rom(p, K))
_SM = "(select path_id, seg, x0, y0, x1, y1, t0, lead(t0) over (partition by path_id order by seg) as t1 from (select path_id, ord - 1 as seg, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1, case when lag(x) over w is null then lead(x) over w - x when lead(x) over w is null then x - lag(x) over w else (lead(x) over w - lag(x) over w) * 0.5::double end as t0 from p {w}))".format(w=_W)
_add("curve_smooth", _SM, ("x0", ("x0 + t0 / 3", "y0"), ("x1 - t1 / 3", "y1"), "x1"), "x1", lambda p: curves.smooth(p, 0.5))
for _kind, _corner in (("after", ("x1", "y0")), ("before", ("x0", "y1")), ("center", ("(x0 + x1) / 2", "(y0 + y1) / 2"))):
    _line = lambda p, q: [f"round({a} + ({b} - {a}) * {t}::double, 4) + 0" for t in (0, 1 / 3, 2 / 3, 1) for a, b in zip(p, q, strict=True)]
    _names = [f"{p}{a}" for p in ("p0", "c1", "c2", "p3") for a in "xy"]
    _halves = [f"select path_id, seg * 2 + {n} as seg, " + ", ".join(f"{z} as {c}" for z, c in zip(_line(p, q), _names, strict=True)) + f" from {_PAIR} where x1 is not null" for n, (p, q) in enumerate(((("x0", "y0"), _corner), (_corner, ("x1", "y1"))))]
    QUERIES[f"curve_step_{_kind}"] = lambda spark, sf_dir, kind=_kind: _flat(curves.step(_paths(spark, sf_dir), kind))
    ORACLES[f"curve_step_{_kind}"] = f"{_P} " + " union all ".join(_halves)
_MONO = "(select path_id, seg, x0, y0, lead(x0) over z as x1, lead(y0) over z as y1, m as m0, lead(m) over z as m1 from (select *, case when s * lead(s) over z < 0 then 0 else s end as m from (select path_id, ord - 1 as seg, x as x0, y as y0, coalesce((y - lag(y) over w) / nullif(x - lag(x) over w, 0), 0) as s from p {w}) window z as (partition by path_id order by seg)) window z as (partition by path_id order by seg))".format(w=_W)
_add("curve_monotone", _MONO, ("x0", ("x0 + (x1 - x0) / 3", f"y0 + m0 * (x1 - x0) / 3 * {K}::double"), ("x1 - (x1 - x0) / 3", f"y1 - m1 * (x1 - x0) / 3 * {K}::double"), "x1"), "x1", lambda p: curves.monotone(p, K))
# closed styles: the points with the last two before them and the first two after
_COUNTED = "(select *, count(*) over (partition by path_id) as n from {t})"
_RING = "ring as (select path_id, n, x, y, unnest(list_filter([ord, case when ord >= n - 1 then ord - n end, case when ord <= 2 then ord + n end], lambda t: t is not null)) as pos from " + _COUNTED + " where n >= 2)"
_PAD3 = "pad as (select path_id, x, y, row_number() over (partition by path_id order by pos) as ord from (select path_id, x, y, unnest(case when n = 2 and ord = 1 then [0, 1] else [ord] end) as pos from " + _COUNTED.format(t="p") + " where n >= 2))"
_AROUND = "(select * from (select path_id, n, pos, pos + 1 as seg, " + ", ".join(f"{'' if k == 0 else f'lead('}{axis}{'' if k == 0 else f', {k}) over w'} as {axis}{k}" for k in range(4) for axis in "xy") + " from ring window w as (partition by path_id order by pos)) where pos <= n - 2)"
_RINGS = {2: _RING.format(t="p"), 3: f"{_PAD3}, {_RING.format(t='pad')}"}
_BASIS = (_lerp(_M12, "(x0 + 2 * x1 + x2) / 4", K), _lerp(_M12, "(x0 + 4 * x1 + x2) / 6", K), _lerp(_M23, "(x1 + 4 * x2 + x3) / 6", K), _lerp(_M23, "(x1 + 2 * x2 + x3) / 4", K))
_add("curve_basis_closed", _AROUND, _BASIS, "x3", lambda p: curves.basis_closed(p, K), pad=_RINGS[3])
_add("curve_cardinal_closed", _AROUND, ("x1", f"x1 + (x2 - x0) * {K}::double / 2", f"x2 - (x3 - x1) * {K}::double / 2", "x2"), "x3", lambda p: curves.cardinal_closed(p, K), pad=_RINGS[2])


def _alpha(alpha: float) -> tuple:
    """Handles with chords to the power of alpha, for x and y."""
    t = {n: f"pow({d}, {alpha}::double)" for n, d in _D.items()}
    near = tuple(_lerp(f"{z}1", _lerp(f"{z}0", f"{z}2", 1).replace(" * 1::double", f" * {t[1]} / nullif({t[1]} + {t[2]}, 0)"), 1 / 3) for z in "xy")
    far = tuple(_lerp(f"{z}2", _lerp(f"{z}1", f"{z}3", 1).replace(" * 1::double", f" * {t[2]} / nullif({t[2]} + {t[3]}, 0)"), -1 / 3) for z in "xy")
    return "x1", near, far, "x2"


_add("curve_catmull_rom_alpha", _CLAMP, _alpha(0.5), "x2", curves.catmull_rom_alpha)
_add("curve_catmull_rom_close", _AROUND, _alpha(1.0), "x3", curves.catmull_rom_close, pad=_RINGS[2])
for _axis, _across in ("xy", "yx"):
    # the slope of each gap, then at each point a weighted harmonic mean of the slopes beside it
    _gap = f"(select path_id, ord, x, y, lead({_axis}) over w - {_axis} as d, coalesce((lead({_across}) over w - {_across}) / nullif(lead({_axis}) over w - {_axis}, 0), case when lead({_axis}) over w is not null then 0 end) as s from p {_W})"
    _mean = f"(select *, case when lag(s) over w is null then s when s is null then lag(s) over w when lag(s) over w * s <= 0 or d + lag(d) over w <= 0 then 0 else (d + lag(d) over w) / (d / lag(s) over w + lag(d) over w / s) end as t from {_gap} {_W})"
    _rows = f"(select path_id, ord - 1 as seg, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1, t as m0, lead(t) over w as m1 from {_mean} {_W})"
    _third = f"({_axis}1 - {_axis}0) / 3"
    _c1 = {_axis: f"{_axis}0 + {_third}", _across: f"{_across}0 + m0 * {_third} * {K}::double"}
    _c2 = {_axis: f"{_axis}1 - {_third}", _across: f"{_across}1 - m1 * {_third} * {K}::double"}
    _add(f"curve_monotone_{_axis}", _rows, ("x0", (_c1["x"], _c1["y"]), (_c2["x"], _c2["y"]), "x1"), "x1", lambda p, axis=_axis: curves.monotone_along(p, K, axis))
# the natural spline's slopes m: elimination from the first point on, then back from the last
_NATURAL = f"""g as (select path_id, ord, x, y, count(*) over (partition by path_id) as n, lead(x) over w - x as h, (lead(y) over w - y) / (lead(x) over w - x) as s from p {_W}),
    q as (select *, lag(h) over w as h0, lag(s) over w as s0 from g where n >= 2 {_W}),
    e(path_id, ord, c, d) as (select path_id, ord, 0.5::double, 1.5 * s from q where ord = 1
        union all select q.path_id, q.ord, (1 / q.h) / (2 / q.h0 + 2 / q.h - e.c / q.h0), (3 * (q.s0 / q.h0 + q.s / q.h) - e.d / q.h0) / (2 / q.h0 + 2 / q.h - e.c / q.h0) from e join q on q.path_id = e.path_id and q.ord = e.ord + 1 where q.ord < q.n),
    m(path_id, ord, m) as (select q.path_id, q.ord, (3 * q.s0 - e.d) / (2 - e.c) from q join e on e.path_id = q.path_id and e.ord = q.n - 1 where q.ord = q.n
        union all select e.path_id, e.ord, e.d - e.c * m.m from m join e on e.path_id = m.path_id and e.ord = m.ord - 1)"""
_SPLINE = "(select q.path_id, q.ord - 1 as seg, q.x as x0, q.y as y0, lead(q.x) over z as x1, lead(q.y) over z as y1, q.h, m.m as m0, lead(m.m) over z as m1 from q join m on m.path_id = q.path_id and m.ord = q.ord window z as (partition by q.path_id order by q.ord))"
_add("curve_natural", _SPLINE, ("x0", (_lerp("(x0 + x1) / 2", "x0 + h / 3", K), _lerp("(y0 + y1) / 2", "y0 + m0 * h / 3", K)), (_lerp("(x0 + x1) / 2", "x1 - h / 3", K), _lerp("(y0 + y1) / 2", "y1 - m1 * h / 3", K)), "x1"), "x1", lambda p: curves.natural(p, K), pad=_NATURAL)
ORACLES["curve_natural"] = ORACLES["curve_natural"].replace("with ", "with recursive ", 1)


_SEGS = "sg as (select *, sum(len) over (partition by path_id order by seg) - len as start, sum(len) over (partition by path_id) as total from (select *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) as len from " + _PAIR + " where x1 is not null))"


@query(f"{_P}, {_SEGS} select path_id, round(sum(len), 4) + 0 as length from sg group by 1")
def polyline_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.length(_paths(spark, sf_dir)).select("path_id", r4(F.col("length")).alias("length"))


@query(f"{_P}, {_SEGS} select path_id, round(x0 + (x1 - x0) * (total * 0.37::double - start) / len, 4) + 0 as x, round(y0 + (y1 - y0) * (total * 0.37::double - start) / len, 4) + 0 as y from sg where start <= total * 0.37::double and total * 0.37::double < start + len")
def polyline_point_at_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polyline.point_at(_paths(spark, sf_dir), 0.37, share=True)
    return rows.select("path_id", r4(F.col("p.x")).alias("x"), r4(F.col("p.y")).alias("y"))


@query(f"{_P}, {_SEGS} select path_id, count(*) as segs, round(sum(least(len, total * 0.4::double - start)), 4) + 0 as length from sg where start < total * 0.4::double group by 1")
def polyline_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polyline.prefix(_paths(spark, sf_dir), 0.4)
    length = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return rows.groupBy("path_id").agg(F.count("*").alias("segs"), r4(F.sum(length)).alias("length"))


def _pieces(rows: DataFrame) -> DataFrame:
    length = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return rows.groupBy("path_id", "piece").agg(r4(F.sum(length)).alias("length"))


_CUTS = "select path_id, k as piece, round(sum(least(start + len, k * {p} + {on}) - greatest(start, k * {p})), 4) + 0 as length from (select *, unnest(range(floor(start / {p})::bigint, floor((start + len) / {p})::bigint + 1)) as k from sg) where greatest(start, k * {p}) < least(start + len, k * {p} + {on}) group by 1, 2"


@query(f"{_P}, {_SEGS} " + _CUTS.format(p="12::double", on="8::double"))
def polyline_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(polyline.dashes(_paths(spark, sf_dir), 8, 4))


@query(f"{_P}, {_SEGS} " + _CUTS.format(p="30::double", on="30::double"))
def polyline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(polyline.split(_paths(spark, sf_dir), 30))


@query(f"{_P} select path_id, row_number() over (partition by path_id order by part, o) - 1 as ord, round(x, 4) + 0 as x, round(y, 4) + 0 as y from (select path_id, 0 as part, ord as o, x, y from p union all select path_id, 1, -ord, x, y + 5 from p)")
def polyline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    rows = polyline.merge(p, p.withColumn("y", F.col("y") + 5))
    return rows.select("path_id", F.col("ord").cast("long").alias("ord"), r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"))


_LB = "greatest(0, least((25 - x0) / (x1 - x0), (85 - x0) / (x1 - x0)), least((40 - y0) / nullif(y1 - y0, 0), (160 - y0) / nullif(y1 - y0, 0))) as t0, least(1, greatest((25 - x0) / (x1 - x0), (85 - x0) / (x1 - x0)), greatest((40 - y0) / nullif(y1 - y0, 0), (160 - y0) / nullif(y1 - y0, 0))) as t1"


@query(f"{_P}, {_SEGS}, cl as (select *, {_LB} from sg) select path_id, seg, round(x0 + (x1 - x0) * t0, 4) + 0 as ax, round(y0 + (y1 - y0) * t0, 4) + 0 as ay, round(x0 + (x1 - x0) * t1, 4) + 0 as bx, round(y0 + (y1 - y0) * t1, 4) + 0 as b_y from cl where t0 <= t1")
def polyline_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polyline.clipped(_paths(spark, sf_dir), rc.rect(25, 40, 85, 160))
    return rows.select("path_id", F.col("seg").cast("long").alias("seg"), *(r4(F.col(f"{p}.{axis}")).alias("b_y" if p + axis == "by" else p + axis) for p in "ab" for axis in "xy"))
