"""Shapes of any kind in one column: a struct with the kind and a field for each kind, one of
which is filled. Predicates and measures of two such columns pick the function for each row's
pair of kinds; rectangles and triangles are polygons. A null shape gives null. `kinds` and
`others` name those that the two columns hold, if not all: fewer make a smaller expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import circle as c_
from . import lines, polygon, sector
from .rect import corners

_POINT = "struct<x:double,y:double>"
KINDS = {"segment": f"struct<start:{_POINT},end:{_POINT}>", "circle": "struct<cx:double,cy:double,r:double>", "polygon": f"array<{_POINT}>", "sector": "struct<cx:double,cy:double,inner:double,outer:double,start:double,sweep:double>"}
#: Chords that stand for each arc of a sector where no exact function exists.
CHORDS = 64


def shape(kind: str, value: Column) -> Column:
    fields = (value if k == kind else F.lit(None) for k in KINDS)
    return F.struct(F.lit(kind).alias("kind"), *(f.cast(t).alias(k) for f, (k, t) in zip(fields, KINDS.items(), strict=True)))


def of_rect(r: Column) -> Column:
    return shape("polygon", corners(r))


def of_triangle(t: Column) -> Column:
    return shape("polygon", polygon.vertices(t))


def _outline(s: Column) -> Column:
    return sector.polygonised(s, CHORDS)


def _pairwise(a: Column, b: Column, kinds: tuple[str, ...], others: tuple[str, ...], table: dict[tuple[str, str], Callable[[Column, Column], Column]]) -> Column:
    def pick(both: Column) -> Column:
        a, b = both["a"], both["b"]
        out = F.when(a["kind"].isNull() | b["kind"].isNull(), F.lit(None))
        for (i, j), f in table.items():
            if i in kinds and j in others:
                out = out.when((a["kind"] == i) & (b["kind"] == j), f(a[i], b[j]))
            if i != j and j in kinds and i in others:
                out = out.when((a["kind"] == j) & (b["kind"] == i), f(b[i], a[j]))
        return out

    # the shapes are worked out once, however often the functions name them
    return _once(F.struct(a.alias("a"), b.alias("b")), pick)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _outlined(f: Callable[[Column, Column], Column], first: bool = False) -> Callable[[Column, Column], Column]:
    """f for a sector's outline in chords, as second argument or as both."""
    if first:
        return lambda o, q: _once(F.struct(_outline(o).alias("o"), _outline(q).alias("q")), lambda s: f(s["o"], s["q"]))
    return lambda x, o: _once(_outline(o), lambda p: f(x, p))


def _by_kind(a: Column, p: Column, table: dict[str, Callable[[Column, Column], Column]]) -> Column:
    def pick(both: Column) -> Column:
        a, p = both["a"], both["p"]
        out = F.when(a["kind"].isNull(), F.lit(None))
        for k, f in table.items():
            out = out.when(a["kind"] == k, f(a[k], p))
        return out

    return _once(F.struct(a.alias("a"), p.alias("p")), pick)


def overlaps(a: Column, b: Column, kinds: tuple[str, ...] = tuple(KINDS), others: tuple[str, ...] = tuple(KINDS)) -> Column:
    """Whether the two, filled and with their boundaries, have a point in common."""
    return _pairwise(a, b, kinds, others, {
        ("segment", "segment"): lines.intersects,
        ("segment", "circle"): lambda s, c: lines.distance_to_point(s, c_.center(c)) <= c["r"],
        ("segment", "polygon"): lambda s, p: polygon.boundary_meets_segment(p, s) | polygon.contains_point(p, s["start"]),
        ("segment", "sector"): lambda s, o: sector.overlaps_segment(o, s),
        ("circle", "circle"): c_.overlaps,
        ("circle", "polygon"): lambda c, p: polygon.overlaps_circle(p, c),
        ("circle", "sector"): lambda c, o: sector.overlaps_circle(o, c),
        ("polygon", "polygon"): polygon.overlaps,
        ("polygon", "sector"): lambda p, o: sector.overlaps_polygon(o, p),
        ("sector", "sector"): lambda o, q: sector.overlaps_sector(o, q, CHORDS),
    })


def distance(a: Column, b: Column, kinds: tuple[str, ...] = tuple(KINDS), others: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The least distance between the two, zero if they overlap."""
    near = _pairwise(a, b, kinds, others, {
        ("segment", "segment"): lines.distance,
        ("segment", "circle"): lambda s, c: c_.distance_to_segment(c, s),
        ("segment", "polygon"): lambda s, p: polygon.distance_to_segment(p, s),
        ("segment", "sector"): _outlined(lambda s, p: polygon.distance_to_segment(p, s)),
        ("circle", "circle"): c_.distance,
        ("circle", "polygon"): lambda c, p: polygon.distance_to_circle(p, c),
        ("circle", "sector"): lambda c, o: F.greatest(F.lit(0.0), sector.distance_to_point(o, c_.center(c)) - c["r"]),
        ("polygon", "polygon"): polygon.distance,
        ("polygon", "sector"): _outlined(polygon.distance),
        ("sector", "sector"): _outlined(polygon.distance, True),
    })
    return F.when(overlaps(a, b, kinds, others), F.lit(0.0)).otherwise(near)


def contains_point(a: Column, p: Column) -> Column:
    return _by_kind(a, p, {"segment": lines.contains_point, "circle": c_.contains_point, "polygon": polygon.contains_point, "sector": sector.contains_point})


def distance_to_point(a: Column, p: Column) -> Column:
    return _by_kind(a, p, {"segment": lines.distance_to_point, "circle": c_.distance_to_point, "polygon": polygon.distance_to_point, "sector": sector.distance_to_point})


def cross_points(a: Column, b: Column, kinds: tuple[str, ...] = tuple(KINDS), others: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The points in which the two boundaries cross; empty where they don't, or share a line."""
    none = F.array().cast(f"array<{_POINT}>")
    one = lambda p: F.when(p.isNull(), none).otherwise(F.array(p))
    return _pairwise(a, b, kinds, others, {
        ("segment", "segment"): lambda s, o: one(lines.cross_point(s, o)),
        ("segment", "circle"): lambda s, c: c_.segment_cross_points(c, s),
        ("segment", "polygon"): lambda s, p: polygon.segment_cross_points(p, s),
        ("segment", "sector"): _outlined(lambda s, p: polygon.segment_cross_points(p, s)),
        ("circle", "circle"): lambda c, o: F.coalesce(c_.cross_points(c, o), none),
        ("circle", "polygon"): lambda c, p: polygon.circle_cross_points(p, c),
        ("circle", "sector"): _outlined(lambda c, p: polygon.circle_cross_points(p, c)),
        ("polygon", "polygon"): polygon.cross_points,
        ("polygon", "sector"): _outlined(polygon.cross_points),
        ("sector", "sector"): _outlined(polygon.cross_points, True),
    })
