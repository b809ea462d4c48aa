"""Traversal ranks, hulls of groups, landmarks and flows on edges against plain Python."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planimetra.operators import points
from planimetra.operators.graph import Graph
from planimetra.operators.tree import Tree


def test_ranks_of_forests(spark):
    rng = random.Random(5)
    parents = {0: None, 1: None}
    for i in range(2, 300):
        parents[i] = rng.randrange(0, i) if i % 9 else i - 1
    order = {i: rng.randrange(5) for i in parents}
    below = defaultdict(list)
    for i, p in parents.items():
        below[p].append(i)
    for own in below.values():
        own.sort(key=lambda i: (order[i], i))
    pre, post, level, row = {}, {}, {}, below[None]

    def walk(i):
        pre[i] = len(pre)
        for c in below[i]:
            walk(c)
        post[i] = len(post)

    for root in below[None]:
        walk(root)
    depth = {}
    for i in parents:
        depth[i] = 0 if parents[i] is None else depth[parents[i]] + 1
    level = {i: k for k, i in enumerate(sorted(parents, key=lambda i: (depth[i], pre[i])))}
    rows = Tree(spark.createDataFrame([(i, p, order[i]) for i, p in parents.items()], "node int, parent int, ord int")).ranks().collect()
    assert {r.node: (r.preorder, r.postorder, r.level_order) for r in rows} == {i: (pre[i], post[i], level[i]) for i in parents}
    assert row == below[None] and Tree(spark.createDataFrame([], "node int, parent int")).ranks().count() == 0


def wrapped(p: set[tuple]) -> set[tuple]:
    """Corners of the hull by gift wrapping; the farthest of points in line."""
    at = start = min(p)
    out = {start}
    while len(p) > 1:
        best = None
        for q in p - {at}:
            turn = 0 if best is None else (best[0] - at[0]) * (q[1] - at[1]) - (best[1] - at[1]) * (q[0] - at[0])
            far = lambda z: (z[0] - at[0]) ** 2 + (z[1] - at[1]) ** 2  # noqa: E731, B023
            if best is None or turn < 0 or turn == 0 and far(q) > far(best):
                best = q
        if best == start:
            break
        out.add(best)
        at = best
    return out


@pytest.mark.parametrize("held", [points.HELD, 4])
def test_hulls_of_groups(spark, monkeypatch, held):
    monkeypatch.setattr(points, "HELD", held)
    rng = random.Random(9)
    groups = {"a": [(rng.randrange(9), rng.randrange(9)) for _ in range(300)], "b": [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)], "one": [(1.0, 2.0)] * 5, "line": [(k, 2 * k) for k in range(7)], None: [(0, 0), (1, 0), (0, 1), (0.2, 0.2)], "two": [(3, 1), (1, 3)]}
    rows = [(g, float(x), float(y)) for g, ps in groups.items() for x, y in ps] + [("a", float("nan"), 1.0), ("a", None, 1.0), ("b", float("inf"), 0.0), ("none", None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "hull string, px double, py double").withColumnRenamed("hull", "g").repartition(4)
    found = {r.g: [(q.x, q.y) for q in r.hull] for r in points.hulls(df, "g", "px", "py").collect()}
    assert found.keys() == groups.keys()
    for g, ps in groups.items():
        want = wrapped({(float(x), float(y)) for x, y in ps})
        assert set(found[g]) == want and len(found[g]) == len(want) and found[g][0] == min(want)
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(found[g], found[g][1:] + found[g][:1]))
        assert area >= 0
    assert points.hulls(df.limit(0), "g", "px", "py").count() == 0


def distances(edges, start):
    out, heap, best = defaultdict(list), [(0.0, start)], {}
    for u, v, w in edges:
        out[u].append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in out[u]:
            heapq.heappush(heap, (d + w, v))
    return best


def test_landmarks_bound_and_prune(spark):
    """A narrow grid with random weights and a part that nothing leads to."""
    rng, wide = random.Random(2), 12
    at = lambda i, j: wide * i + j
    edges = [(at(i, j), at(i + a, j + b), rng.uniform(1, 1.3)) for i in range(3) for j in range(wide) for a, b in ((1, 0), (0, 1)) if i + a < 3 and j + b < wide] + [(900, 901, 1.0)]
    both = edges + [(v, u, w) for u, v, w in edges]
    graph = Graph(spark.createDataFrame(edges, "src int, dst int, weight double"), directed=False)
    start, goal = at(1, 5), at(2, 9)
    to_goal = distances(both, goal)
    table = graph.landmark_bounds(goal, 1)
    assert all(r.id >= 900 or r.bound <= to_goal[r.id] for r in table.collect())
    found = graph.a_star(start, goal, table).collect()
    assert len(found) == 1 and found[0].dist == pytest.approx(to_goal[start])
    assert sum(e.weight for e in found[0].path) == pytest.approx(to_goal[start])
    assert found[0].path[0].src == start and found[0].path[-1].dst == goal and all(a.dst == b.src for a, b in zip(found[0].path, found[0].path[1:]))
    settled = lambda bounds: graph._best_first(start, goal, bounds).count()
    assert settled(table) < 0.8 * settled(table.select("id", F.lit(0.0).alias("bound")))


def test_landmarks_of_directed_graphs(spark):
    graph = Graph(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 1.0), (8, 9, 1.0), (2, 2, 0.0)], "src int, dst int, weight double"))
    table = graph.landmark_bounds(3, 2)
    assert {r.id: r.bound for r in table.collect() if r.id < 8} == {1: pytest.approx(2.0), 2: pytest.approx(1.0), 3: 0.0}
    assert [(r.dist, len(r.path)) for r in graph.a_star(1, 3, table).collect()] == [(2.0, 2)]
    assert graph.a_star(1, 9, graph.landmark_bounds(9, 1)).isEmpty()
    assert [(r.dist, r.path) for r in graph.a_star(3, 3, table).collect()] == [(0.0, [])]


def least_cut(edges, source, sink) -> int:
    """Over all sets of vertices."""
    inner = sorted({x for u, v, _ in edges for x in (u, v)} - {source, sink})
    sides = ({source} | {x for k, x in enumerate(inner) if m >> k & 1} for m in range(1 << len(inner)))
    return min(sum(c for u, v, c in edges if u in side and v not in side) for side in sides)


@pytest.mark.parametrize("seed", [1, 2])
def test_flows_on_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(u, v, rng.randrange(0, 9)) for u in range(8) for v in range(8) if u != v and rng.random() < 0.4]
    edges += [(0, 3, 4), (0, 3, 2), (5, 7, 5), (2, 2, 9), (6, 1, 3), (1, 6, 2)]
    graph = Graph(spark.createDataFrame(edges, "src int, dst int, weight int"))
    flows, side = graph.push_relabel(0, 7)
    flow = {(r.src, r.dst): r.flow for r in flows.collect()}
    room, at = defaultdict(int), defaultdict(int)
    for u, v, c in edges:
        room[u, v] += c
    for (u, v), f in flow.items():
        assert 0 < f <= room[u, v]
        at[u] -= f
        at[v] += f
    want = least_cut(edges, 0, 7)
    assert want > 0 and at[7] == want == -at[0] and all(at[v] == 0 for v in range(1, 7))
    low = {r.id for r in side.collect()}
    assert 0 in low and 7 not in low and sum(c for u, v, c in edges if u in low and v not in low) == want


def test_flows_that_cannot_pass(spark):
    table = spark.createDataFrame([("s", "a", 5), ("a", "b", 3), ("x", "t", 2)], "src string, dst string, capacity int")
    assert Graph.max_flow_of(table, "s", "t") == 0
    assert Graph.max_flow_of(table.union(spark.createDataFrame([("b", "x", 9)], table.schema)), "s", "t") == 2
    with pytest.raises(ValueError):
        Graph.max_flow_of(table, "s", "s")


def test_supply_flow(spark):
    """Against matching lines one by one to suppliers with something left."""
    from planimetra.plans import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    found = QUERIES["graph_supply_flow"](spark, sf_dir).collect()
    makers, left = defaultdict(list), defaultdict(int)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        makers[r.l_partkey].append(r.l_suppkey)
        left[r.l_suppkey] += 1
    room = {s: n // 2 for s, n in left.items()}
    served = {s: set() for s in room}  # the lines (part, 0 or 1) that each supplier fills

    def fill(line, tried) -> bool:
        for s in makers[line[0]]:
            if s in tried or (line[0], 1 - line[1]) in served[s]:
                continue
            tried.add(s)
            if len(served[s]) < room[s]:
                served[s].add(line)
                return True
            for other in list(served[s]):
                if fill(other, tried):
                    served[s].remove(other)
                    served[s].add(line)
                    return True
        return False

    want = sum(fill((p, k), set()) for p in makers for k in (0, 1))
    assert [(r.flow, r.cut, r.unbalanced) for r in found] == [(want, want, 0)]
