"""Functions and operators that no SQL expresses, against plain Python."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from planimetra.functions import bezier, circle, lines, polygon, rect, sector, shape
from planimetra.functions import vector as v
from planimetra.operators.graph import Graph
from planimetra.operators.tree import Tree
from planimetra.plans import QUERIES
from planimetra.sources import tables as tb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def shapes(spark):
    return {r.id: r for r in tb.shapes(spark, SF_DIR).collect()}


def kite(s) -> list:
    p, q = s.c + 1, s.d + 1
    return [(s.a - p, s.b), (s.a, s.b - q), (s.a + p, s.b), (s.a, s.b + q)]


def area_of(ring) -> float:
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def wrapped(points) -> list:
    """The convex hull by gift wrapping."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out, at = [], points[0]
    while not out or at != out[0]:
        out.append(at)
        end = points[0] if points[0] != at else points[1]
        for q in points:
            turn = (end[0] - at[0]) * (q[1] - at[1]) - (end[1] - at[1]) * (q[0] - at[0])
            if q != at and (turn < 0 or turn == 0 and math.dist(at, q) > math.dist(at, end)):
                end = q
        at = end
    return out


def test_polygon_hull_clip(spark, shapes):
    for r in QUERIES["polygon_hull_clip"](spark, SF_DIR).collect():
        s = shapes[r.id]
        hull = wrapped([(s.a, s.b), (s.c, s.d), (s.e, s.f), (s.g, s.h), (s.i, s.j)])
        assert r.hull == len(hull) and r.hull_area == pytest.approx(area_of(hull), abs=1e-4)
        # the kite's area inside the box, by the trapezoids between its breaks
        def height(x, s=s):
            room = (s.d + 1) * (1 - abs(x - s.a) / (s.c + 1))
            return max(0.0, min(9, s.b + room) - max(2, s.b - room)) if room > 0 else 0.0

        breaks = {2.0, 9.0, s.a, s.a - s.c - 1, s.a + s.c + 1}
        for y in (2, 9):
            d = (1 - abs(y - s.b) / (s.d + 1)) * (s.c + 1)
            breaks |= {s.a - d, s.a + d}
        xs = sorted(x for x in breaks if 2 <= x <= 9)
        want = sum((q - p) * (height(p + 1e-12) + height(q - 1e-12)) / 2 for p, q in zip(xs, xs[1:], strict=False))
        assert r.clip_area == pytest.approx(want, abs=1e-3)


def test_bezier_lengths(spark, shapes):
    rows = QUERIES["bezier_lengths"](spark, SF_DIR).collect()
    for r in rows[:40]:
        s = shapes[r.id]
        p = _bezier_points(spark, r.id)
        at = lambda t: tuple((1 - t) ** 3 * p[0][k] + 3 * (1 - t) ** 2 * t * p[1][k] + 3 * (1 - t) * t * t * p[2][k] + t**3 * p[3][k] for k in (0, 1))  # noqa: E731, B023
        control = sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))
        n = max(8, min(1000, math.ceil(0.75 * control)))
        sums = [0.0]
        for i in range(n):
            sums.append(sums[-1] + math.dist(at(i / n), at((i + 1) / n)))
        k = max(i for i in range(n) if sums[i] <= sums[-1] / 2)
        half = at((k + (sums[-1] / 2 - sums[k]) / (sums[k + 1] - sums[k])) / n)
        fine = [at(i / 4000) for i in range(4001)]
        assert r.length == pytest.approx(sums[-1], abs=1e-3)
        assert (r.hx, r.hy) == pytest.approx(half, abs=1e-3)
        assert r.xmin == pytest.approx(min(x for x, _ in fine), abs=1e-2) and r.xmax == pytest.approx(max(x for x, _ in fine), abs=1e-2)
        assert r.pieces == 4
        assert r.near == (min(math.dist(at(i / 100), (s.c, s.d)) for i in range(101)) < 2)


_CURVES: dict = {}


def _bezier_points(spark, id) -> list:
    from planimetra.plans import scalar_queries

    if not _CURVES:
        for r in tb.shapes(spark, SF_DIR).select("id", scalar_queries._bezier().alias("k")).collect():
            _CURVES[r.id] = [(r.k[n].x, r.k[n].y) for n in ("p0", "c1", "c2", "p3")]
    return _CURVES[id]


def test_bezier_by_length(spark):
    k = bezier.curve(v.point(F.lit(0.0), F.lit(0.0)), v.point(F.lit(0.0), F.lit(30.0)), v.point(F.lit(40.0), F.lit(30.0)), v.point(F.lit(50.0), F.lit(0.0)))
    row = spark.range(1).select(bezier.even_ts(k, 10).alias("ts"), bezier.length(k).alias("n"), bezier.tangent_at_length(k, F.lit(0.0)).alias("t"), bezier.reversed_curve(k).alias("r"), bezier.split_parts(k, 3).alias("parts")).first()
    at = lambda t: (120 * (1 - t) * t * t + 50 * t**3, 90 * (1 - t) ** 2 * t + 90 * (1 - t) * t * t)
    steps = [at(i / 5000) for i in range(5001)]
    sums = [0.0]
    for a, b in zip(steps, steps[1:], strict=False):
        sums.append(sums[-1] + math.dist(a, b))
    assert row.n == pytest.approx(sums[-1], rel=1e-3)
    assert [sums[round(t * 5000)] for t in row.ts] == pytest.approx([sums[-1] * i / 10 for i in range(11)], abs=0.1)
    assert (row.t.x, row.t.y) == pytest.approx((0, 1)) and (row.r.p0.x, row.r.p3.y) == (50, 0)
    for i, part in enumerate(row.parts):
        assert (part.p0.x, part.p0.y) == pytest.approx(at(i / 3)) and (part.p3.x, part.p3.y) == pytest.approx(at((i + 1) / 3))


def test_bezier_even(spark, shapes):
    """Against lengths integrated in 4,000 places; every curve's parameters grow from 0 to 1."""
    rows = QUERIES["bezier_even"](spark, SF_DIR).collect()
    assert len(rows) == len(shapes)
    ts = (np.arange(4000) + 0.5) / 4000
    for r in rows:
        assert r.ts[0] == 0 and r.ts[-1] == 1 and r.ts == sorted(r.ts)
    for r in rows[:60]:
        p = np.array(_bezier_points(spark, r.id))
        d = np.diff(p, axis=0) * 3
        slope = lambda t: np.outer((1 - t) ** 2, d[0]) + np.outer(2 * (1 - t) * t, d[1]) + np.outer(t * t, d[2])  # noqa: E731, B023
        sums = np.concatenate([[0], np.cumsum(np.hypot(*slope(ts).T)) / 4000])
        total = sums[-1]
        # a near standstill in a part costs the rule some digits
        calm = np.hypot(*slope(ts).T).min() > 0.2 * total
        got = np.interp(r.ts, np.linspace(0, 1, 4001), sums)
        assert got == pytest.approx(total * np.arange(5) / 4, abs=total * (1e-5 if calm else 2e-3))
        t = np.interp(min(5.0, total), sums, np.linspace(0, 1, 4001))
        way = slope(np.array([t]))[0]
        if calm:
            assert (r.tangent.x, r.tangent.y) == pytest.approx(tuple(way / np.hypot(*way)), abs=1e-4)


def test_even_spacing_of_points_and_lines(spark):
    """A curve that is a point, and a straight one."""
    dot, line = bezier.of_line(v.point(F.lit(3.0), F.lit(3.0)), v.point(F.lit(3.0), F.lit(3.0))), bezier.of_line(v.point(F.lit(0.0), F.lit(0.0)), v.point(F.lit(8.0), F.lit(0.0)))
    row = spark.range(1).select(bezier.even_ts(dot, 2).alias("dot"), bezier.even_ts(line, 4).alias("line"), bezier.tangent_at_length(dot, 1.0).alias("none"), bezier.tangent_at_length(line, 99.0).alias("past")).first()
    assert len(row.dot) == 3 and row.line == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    assert (row.none.x, row.none.y) == (0, 0) and (row.past.x, row.past.y) == pytest.approx((1, 0))


def in_sector(s, x, y, grow=0.0) -> bool:
    """Whether a point lies in the sector, grown or shrunk by a distance at arcs and sides."""
    d, turned = math.hypot(x - s.a, y - s.b), (math.atan2(y - s.b, x - s.a) - s.j) % (2 * math.pi)
    slack = grow / max(d, 1e-9)
    return s.c - grow <= d <= s.c + s.e + 1 + grow and (turned <= s.g + slack or turned >= 2 * math.pi - slack)


def test_sector_overlaps(spark, shapes):
    rng, kinds = random.Random(1), {"circle": 0, "rect": 0, "segment": 0, "kite": 0}
    for r in QUERIES["sector_overlaps"](spark, SF_DIR).collect():
        s = shapes[r.id]
        if not 0.05 < s.g < 6.2:
            continue
        disc = [(s.d + q * math.cos(t), s.f + q * math.sin(t)) for q, t in ((s.e * math.sqrt(rng.random()), rng.random() * 7) for _ in range(1500))]
        box = [(s.d + 2 * rng.random(), s.f + 2 * rng.random()) for _ in range(800)]
        line = [(s.d + (s.f - s.d) * t, s.f + (s.d - s.f) * t) for t in (i / 800 for i in range(801))]
        p, q = s.c + 1, s.d + 1
        inside = [(s.a + p * x, s.b + q * y) for x, y in ((rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(3000)) if abs(x) + abs(y) <= 1]
        for name, points in (("circle", disc), ("rect", box), ("segment", line), ("kite", inside)):
            # points well inside prove an overlap; none even near it prove that there is none
            if any(in_sector(s, x, y, -1e-6) for x, y in points):
                assert r[name], (name, s)
                kinds[name] += 1
            elif r[name]:
                assert any(in_sector(s, x, y, 0.8) for x, y in points), (name, s)
    assert min(kinds.values()) > 0


def snapped_one_by_one(points, tolerance: float) -> list:
    """x, y and count of the representatives of points (order, x, y)."""
    kept: list = []
    for _, x, y in sorted(points):
        near = [((q[0] - x) ** 2 + (q[1] - y) ** 2, q[0], q[1], q) for q in kept]
        best = min((n for n in near if n[0] <= tolerance * tolerance), default=None)
        if best:
            best[3][2] += 1
        else:
            kept.append([x, y, 1])
    return sorted(map(tuple, kept))


def test_snapped_points(spark):
    rows = [(r.id, r.x, r.y) for r in tb.customer_points(spark, SF_DIR).collect()]
    found = sorted((r.x, r.y, r.n) for r in QUERIES["snapped_points"](spark, SF_DIR).collect())
    assert found == snapped_one_by_one(rows, 0.2) and len(found) < len(rows)


@pytest.mark.parametrize("rounds", [50, 1])
def test_snapped_clouds_and_chains(spark, monkeypatch, rounds):
    """A full cell, dense clouds with repeats, and a chain in order; with and without settling one by one."""
    from planimetra.operators import points

    monkeypatch.setattr(points, "HUB", 20)
    monkeypatch.setattr(points, "ROUNDS", rounds)
    rng = random.Random(3)
    at = [(rng.gauss(0, 0.9), rng.gauss(0, 0.9)) for _ in range(300)] + [(5 + rng.random() / 9, 5 + rng.random() / 9) for _ in range(150)]
    at += rng.choices(at, k=60) + [(-9 + k / 8, -7.5) for k in range(20)] + [(0.0, 1.0), (-0.0, 1.0)]
    rng.shuffle(at)
    rows = [(rng.randrange(200), x, y) for x, y in at[:-40]] + [(300 + k, x, y) for k, (x, y) in enumerate(sorted(at[-40:]))]
    df = spark.createDataFrame([*rows, (1, None, 2.0), (2, math.nan, 3.0)], "id long, x double, y double")
    found = sorted((r.x, r.y, r.n) for r in points.snapped(df, 0.5, "id").collect())
    assert found == snapped_one_by_one(rows, 0.5)
    assert points.snapped(df.limit(0), 0.5, "id").isEmpty()


def test_clip_parts(spark):
    comb = [(0, 0), (10, 0), (10, 5), (8, 5), (8, 1), (6, 1), (6, 5), (4, 5), (4, 1), (2, 1), (2, 5), (0, 5)]  # three teeth
    cases = [
        (comb, (-1, 2, 11, 4), [4.0, 4.0, 4.0]),  # across the teeth
        (comb, (-1, -1, 11, 9), [area_of(comb)]),  # all of it
        (comb, (1, 2, 1.5, 3), [0.5]),  # the box inside a tooth
        (comb, (2.5, 2, 3.5, 3), []),  # between the teeth
        (comb, (1, 0.5, 9, 3), None),
        (comb[::-1], (-1, 2, 11, 4), [4.0, 4.0, 4.0]),
        ([(0, 0), (4, 0), (4, 4), (0, 4)], (2, 2, 9, 9), [4.0]),
    ]
    rows = [([{"x": float(x), "y": float(y)} for x, y in p], *map(float, box)) for p, box, _ in cases]
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double>>, a double, b double, c double, d double")
    found = [r.parts for r in df.select(polygon.clip_parts(F.col("p"), rect.rect("a", "b", "c", "d")).alias("parts")).collect()]
    for (_, box, want), parts in zip(cases, found, strict=True):
        rings = [[(q.x, q.y) for q in ring] for ring in parts]
        areas = sorted(round(area_of(r), 9) for r in rings)
        assert want is None or areas == sorted(want)
        assert all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for r in rings for x, y in r)
    assert sum(area_of([(q.x, q.y) for q in ring]) for ring in found[4]) == pytest.approx(8 * 0.5 + (1 + 2 + 1) * 2)


def test_shapes_of_any_kind(spark):
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    parts = {
        "segment": shape.shape("segment", lines.segment(v.point(*lit(0, 0)), v.point(*lit(4, 0)))),
        "circle": shape.shape("circle", circle.circle(*lit(2, 3, 1))),
        "square": shape.of_rect(rect.rect(5, 0, 6, 1)),
        "sector": shape.shape("sector", sector.sector(*lit(10, 0, 1, 2, 0, 7))),
    }
    rows = spark.range(1).select(*(x.alias(k) for k, x in parts.items()))
    pairs = {("segment", "circle"): 2.0, ("segment", "square"): 1.0, ("circle", "square"): math.sqrt(13) - 1, ("segment", "sector"): 4.0, ("circle", "sector"): math.hypot(8, 3) - 3, ("circle", "circle"): 0.0}
    kind = lambda n: ("polygon" if n == "square" else n,)
    for (m, n), want in pairs.items():
        for x, y in ((m, n), (n, m)) if m == "segment" else ((m, n),):
            r = rows.select(shape.distance(F.col(x), F.col(y), kind(x), kind(y)).alias("d"), shape.overlaps(F.col(x), F.col(y), kind(x), kind(y)).alias("o")).first()
            assert r.d == pytest.approx(want, abs=5e-3) and r.o == (want == 0)
    inside = rows.select(*(shape.contains_point(F.col(k), v.point(*lit(*p))).alias(k) for k, p in {"segment": (1, 0), "circle": (2, 3.5), "square": (5.5, 0.5), "sector": (11.5, 0.1)}.items())).first()
    assert all(inside)
    far = rows.select(*(shape.distance_to_point(F.col(k), v.point(*lit(2, 9))).alias(k) for k in ("segment", "circle", "square"))).first()
    assert list(far) == pytest.approx([9, 5, math.sqrt(9 + 64)])
    (q,) = rows.select(shape.cross_points(F.col("segment"), shape.shape("segment", lines.segment(v.point(*lit(1, -1)), v.point(*lit(1, 1)))), ("segment",), ("segment",)).alias("q")).first().q
    assert (q.x, q.y) == (1, 0)


def test_matrix_traversals_and_capacities(spark):
    cells = [(i, j, int((i * 5 + j * 3) % 4 == 0 and i != j)) for i in range(7) for j in range(7)]
    g = Graph.of_matrix(spark.createDataFrame(cells, "i long, j long, value int"), 7)
    out = {i: [j for a, j, x in cells if a == i and x] for i in range(7)}
    order, seen = [], set()

    def visit(i) -> None:
        seen.add(i)
        order.append(i)
        for j in out[i]:
            if j not in seen:
                visit(j)

    visit(0)
    assert [r.id for r in sorted(g.dfs(0).collect(), key=lambda r: r.ord)] == order
    queue = [0]
    for i in queue:
        queue += [j for j in out[i] if j not in queue]
    assert [r.id for r in sorted(g.bfs(0).collect(), key=lambda r: (r.level, r.trail))] == queue
    assert g.vertices.count() == 7
    capacities = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)], "src long, dst long, capacity int")
    assert Graph.max_flow_of(capacities, 0, 3) == 5


def test_graph_edits_and_errors(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, -2.0)], "src long, dst long, weight double")
    g = Graph(edges)
    more = g.add_vertices(spark.createDataFrame([(9,)], "id long"))
    assert more.vertices.count() == 4 and not g.equals(more) and g.equals(Graph(edges.orderBy("dst")))
    with pytest.raises(ValueError, match="Negative"):
        g.dijkstra(1)
    assert {r.id: r.dist for r in g.bellman_ford_pair(1, 3).collect()} == {3: -1.0}
    with pytest.raises(ValueError, match="cycle"):
        g.add_edges(spark.createDataFrame([(3, 1, 0.5)], "src long, dst long, weight double")).bellman_ford(1)


def test_tree_edits(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 1), ("b", "r", 2), ("c", "r", 3), ("d", "a", 1)], "node string, parent string, ord long")
    tree = Tree(nodes)
    grown = tree.add(spark.createDataFrame([("e", "b"), ("f", "new"), ("g", "f")], "node string, parent string"))
    assert {r.node: "/".join(r.path) for r in grown.paths.collect()} == {"r": "r", "a": "r/a", "b": "r/b", "c": "r/c", "d": "r/a/d", "e": "r/b/e", "new": "r/new", "f": "r/new/f", "g": "r/new/f/g"}
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    left = lambda t: sorted(r.node for r in t.paths.collect())
    assert left(tree.remove_first(of("r"))) == ["b", "c", "r"] and left(tree.remove_last(of("r", "a"))) == ["a", "b", "r"]
    assert left(tree.remove_at(spark.createDataFrame([("r", 1), ("r", 8)], "node string, place int"))) == ["a", "c", "d", "r"]
    assert left(tree.remove_where(F.expr("node > 'b' and parent is not null"))) == ["a", "b", "r"] and left(tree.remove_children(of("r"))) == ["r"]


def test_long_and_turning_splines(spark):
    """A path of several blocks has the slopes of one solution; one that turns back is still solved."""
    from planimetra.operators import curves

    rng = random.Random(8)
    x, points = 0.0, []
    for k in range(1500):
        x += rng.choice([0.01, 1.0, 30.0])
        points.append((1, k, x, rng.uniform(-50, 50)))
    points += [(2, k, float(u), float(w)) for k, (u, w) in enumerate([(0, 1), (3, 4), (1, 2), (6, 0), (9, 5)])]
    points += [(3, k, 1000 * math.sin(k) + k, rng.uniform(-50, 50)) for k in range(400)]
    points += [(4, k, 10.0 * (k % 2), float(k)) for k in range(3)] + [(6, k, float(k - k // 99), 1.0) for k in range(200)] + [(5, k, float(u), 1.0) for k, u in enumerate([1, 2, 2, 3])]
    df = spark.createDataFrame(points, "path_id long, ord long, x double, y double")
    found = {(r.path_id, r.seg): r.curve for r in curves.natural(df).collect()}
    for path, n in ((4, 2), (5, 3), (6, 199)):  # nothing determines the slopes
        assert sum(p == path for p, _ in found) == n and all(math.isnan(c.c1.y) for (p, _), c in found.items() if p == path)
    for path in (1, 2, 3):
        own = [(p[2], p[3]) for p in points if p[0] == path]
        n = len(own)
        assert sum(k[0] == path for k in found) == n - 1
        for i in range(n - 1):
            c = found[path, i]
            h = c.p3.x - c.p0.x
            second = lambda t, c=c, h=h: (6 * (1 - t) * (c.p0.y - 2 * c.c1.y + c.c2.y) + 6 * t * (c.c1.y - 2 * c.c2.y + c.p3.y)) / h**2
            scale = 1e-6 * max(1.0, abs(second(0)), abs(second(1)))
            if i == 0:
                assert abs(second(0)) < scale
            else:
                b = found[path, i - 1]
                g = b.p3.x - b.p0.x
                before = 6 * (b.c1.y - 2 * b.c2.y + b.p3.y) / g**2
                assert before == pytest.approx(second(0), abs=1e-5 * max(1.0, abs(before)))
                assert (b.p3.y - b.c2.y) / g == pytest.approx((c.c1.y - c.p0.y) / h, abs=1e-6 * max(1.0, abs((c.c1.y - c.p0.y) / h)))


def test_blocks_of_blocks(spark, monkeypatch):
    """Tridiagonal systems of several levels of blocks, without a strong diagonal."""
    from planimetra.operators import curves

    monkeypatch.setattr(curves, "BLOCK", 4)
    rng, rows, want = random.Random(2), [], {}
    for path, n in ((7, 70), (8, 5), (9, 4), (10, 17)):
        eqs = [[rng.uniform(-1, 1) * (i > 0), rng.uniform(-2, 2), rng.uniform(-1, 1) * (i < n - 1), rng.uniform(-9, 9)] for i in range(n)]
        matrix = np.diag([e[1] for e in eqs]) + np.diag([e[0] for e in eqs[1:]], -1) + np.diag([e[2] for e in eqs[:-1]], 1)
        want |= {(path, i): m for i, m in enumerate(np.linalg.solve(matrix, [e[3] for e in eqs]))}
        rows += [(path, i, n, e) for i, e in enumerate(eqs)]
    found = curves._unknowns(spark.createDataFrame(rows, "path_id long, at long, count long, eq array<double>")).collect()
    assert {(r.path_id, r["at"]): r.found[0] for r in found} == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_heap_and_order(spark):
    from planimetra.operators import ordered

    numbers = spark.createDataFrame([(i, x) for i, x in enumerate([1, 3, 2, 7, 4, 2])], "at long, k long")
    assert ordered.is_heap(numbers, "at", "k").first().valid
    assert not ordered.is_heap(numbers.withColumn("k", -F.col("k")), "at", "k").first().valid
    placed = ordered.placed(numbers, "k").collect()
    assert sorted((r.place, r.k) for r in placed) == list(enumerate(sorted([1, 3, 2, 7, 4, 2]), 1))
    assert ordered.least(numbers, "k").first().k == 1 and ordered.greatest(numbers, "k").first().k == 7
    assert ordered.add(numbers, numbers).count() == 12
    many = [(k % 3, k, k + (5000 if k == bad else 0)) for bad in (None, 1500, 2999) for k in range(3000)]
    frames = [spark.createDataFrame(many[i : i + 3000], "g int, at long, k long").repartition(5) for i in (0, 3000, 6000)]
    assert [ordered.is_ordered(f, "at", "k").first().valid for f in frames] == [True, False, True]
    assert [ordered.is_ordered(f, "at", "k", "g").first().valid for f in frames] == [True, False, True]
    assert ordered.is_ordered(frames[0].limit(0), "at", "k").first().valid


def test_spatial_layout_is_readable(spark, tmp_path):
    boxes = tb.part_rects(spark, SF_DIR)
    tb.write_spatial(boxes, str(tmp_path / "boxes"), slices=4)
    again = spark.read.parquet(str(tmp_path / "boxes"))
    assert again.count() == boxes.count() and again.select(*boxes.columns).exceptAll(boxes).isEmpty()


#: Queries without SQL, and the test that holds each against plain Python.
TESTED = {
    "bezier_even": "here",
    "polygon_hull_clip": "here", "bezier_lengths": "here", "sector_overlaps": "here", "snapped_points": "here",
    "graph_matching": "test_whole_jobs", "graph_dfs": "test_whole_jobs", "graph_supply_flow": "test_rounds",
    "tree_preorder_all": "test_whole_jobs", "tree_postorder_all": "test_whole_jobs", "tree_level_order_all": "test_whole_jobs",
}


def test_every_query_without_sql_is_tested():
    from planimetra.plans import ORACLES

    assert set(QUERIES) - set(ORACLES) == set(TESTED)
    assert connect(SF_DIR)
