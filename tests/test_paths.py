"""Shortest paths by the vertices before, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planimetra.operators.graph import Graph

EDGES = "src int, dst int, weight double"


def nearest(edges, start):
    """id: (dist, hops, before), by relaxing all edges until none changes."""
    best, changed = {start: (0.0, 0, None)}, True
    while changed:
        changed = False
        for u, v, w in edges:
            if u in best and (v not in best or (best[u][0] + w, best[u][1] + 1) < best[v][:2] or v != start and (best[u][0] + w, best[u][1] + 1) == best[v][:2] and u < best[v][2]):
                best[v], changed = (best[u][0] + w, best[u][1] + 1, u), True
    return best


def shaped(seed):
    """Random edges, runs of all lengths between and beside them, circles, loops, parallels and ties."""
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(0, 6))) for _ in range(18)]
    fresh = 100
    for _ in range(9):
        a, b, n = rng.randrange(12), rng.randrange(12), rng.randrange(1, 9)
        run = [a, *range(fresh, fresh + n), *([b] if rng.random() < 0.7 else [])]
        fresh += n
        edges += [(u, v, float(rng.randrange(0, 4))) if rng.random() < 0.8 else (v, u, 1.0) for u, v in zip(run, run[1:])]
    circle = [fresh, fresh + 1, fresh + 2, fresh]
    return edges + [(u, v, 1.0) for u, v in zip(circle, circle[1:])] + [(3, 3, 0.0), *edges[:2]]


@pytest.mark.parametrize(("seed", "directed"), [(1, True), (2, False), (3, True), (4, False)])
def test_distances_and_paths(spark, seed, directed):
    edges = shaped(seed)
    both = edges if directed else edges + [(v, u, w) for u, v, w in edges]
    graph = Graph(spark.createDataFrame(edges, EDGES), directed=directed)
    weight = {}
    for u, v, w in both:
        weight[u, v] = min(w, weight.get((u, v), w))
    inner = next(v for u, v, _ in edges if v >= 101)
    for start in (0, inner):
        want = nearest(both, start)
        found = graph.distances(start)
        assert {r.id: (r.dist, r.hops, r.before) for r in found.collect()} == want
        rows = graph.dijkstra(start).collect()
        assert {r.id: r.dist for r in rows} == {v: d for v, (d, _, _) in want.items()}
        for r in rows:
            way, at = [], r.id
            while want[at][2] is not None:
                way.append((want[at][2], at, weight[want[at][2], at]))
                at = want[at][2]
            assert [tuple(e) for e in r.path] == way[::-1]
        goal = max(want)
        one = graph.dijkstra_pair(start, goal).collect()
        assert [r.dist for r in one] == [want[goal][0]] and sum(e.weight for e in one[0].path) == want[goal][0]
    assert graph.dijkstra_pair(0, 9999).isEmpty() and graph.distances(9999).isEmpty()


@pytest.mark.parametrize("directed", [True, False])
def test_long_chain(spark, directed):
    """10,000 vertices in a row, in the rounds that pointer doubling takes."""
    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") % 3 + 1).cast("double").alias("weight"))
    graph = Graph(edges.repartition(8), directed=directed)
    found = graph.distances(0)
    total, want = 0.0, []
    for k in range(n):
        want.append((k, total, k))
        total += k % 3 + 1
    assert [tuple(r) for r in found.select("id", "dist", "hops").orderBy("id").collect()] == want
    path = graph.path_to(found, spark.range(n - 1, n)).collect()[0].path
    assert [e.src for e in path] == list(range(n - 1))


def test_negative_and_missing_weights(spark):
    edges = [(1, 2, 4.0), (1, 3, 2.0), (3, 2, -3.0), (2, 4, 1.0), (4, 5, None), (4, 6, None), (4, 6, 2.0)]
    graph = Graph(spark.createDataFrame(edges, EDGES))
    want = {1: (0.0, 0, None), 2: (-1.0, 2, 3), 3: (2.0, 1, 1), 4: (0.0, 3, 2), 6: (2.0, 4, 4)}
    assert {r.id: (r.dist, r.hops, r.before) for r in graph.bellman_ford_distances(1).collect()} == want
    assert [[(e.src, e.dst) for e in r.path] for r in graph.bellman_ford_pair(1, 4).collect()] == [[(1, 3), (3, 2), (2, 4)]]
    johnson = {(r.source, r.id): (r.dist, len(r.path)) for r in graph.johnson().collect()}
    assert johnson[1, 6] == (2.0, 4) and johnson[3, 4] == (-2.0, 2) and (5, 1) not in johnson
    with pytest.raises(ValueError):
        graph.distances(1)
    loop = Graph(spark.createDataFrame([(1, 2, 1.0), (2, 2, -1.0)], EDGES))
    with pytest.raises(ValueError):
        loop.bellman_ford(1)


def test_estimates_of_a_column(spark):
    """A grid's distance in steps as the estimate."""
    n, edges = 7, []
    for i in range(n):
        for j in range(n):
            edges += [(n * i + j, n * (i + a) + j + b, 1.0) for a, b in ((1, 0), (0, 1)) if i + a < n and j + b < n and (i, j) != (3, 3)]
    graph = Graph(spark.createDataFrame(edges, EDGES), directed=False)
    goal = n * 5 + 6
    rest = F.abs(F.floor(F.col("id") / n) - 5) + F.abs(F.col("id") % n - 6)
    found = graph.a_star(0, goal, rest).collect()
    assert [r.dist for r in found] == [11.0] and len(found[0].path) == 11
    assert graph.a_star(0, goal).first().dist == 11.0


def test_empty_graph(spark):
    graph = Graph(spark.createDataFrame([], EDGES), spark.createDataFrame([(1,)], "id int"))
    assert [tuple(r) for r in graph.distances(1).collect()] == [(1, 0.0, 0, None)]
    assert [(r.id, r.path) for r in graph.dijkstra(1).collect()] == [(1, [])]
    assert defaultdict(int, {r.src: r.dist for r in graph.floyd_warshall().collect()}) == {1: 0.0}
