"""Distances of all pairs by tiles, and layers by contraction, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from planimetra.operators.graph import Graph
from planimetra.session import drop_stored, stored

EDGES = "src int, dst int, weight double"
INF = float("inf")


def all_pairs(edges, ids):
    d = {(a, b): 0.0 if a == b else INF for a in ids for b in ids}
    for u, v, w in edges:
        if u != v and w is not None:
            d[u, v] = min(d[u, v], w)
    for k in ids:
        for a in ids:
            for b in ids:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return {pair: x for pair, x in d.items() if x < INF}


@pytest.mark.parametrize(("side", "directed"), [(4, True), (3, False), (100, True)])
def test_random_graphs(spark, side, directed):
    """Unreachable pairs, parallel edges, loops, missing and (by a potential, so without negative cycles) negative weights."""
    rng = random.Random(side)
    high = {v: float(rng.randrange(-9, 9)) if directed else 0.0 for v in range(0, 26, 2)}
    edges = [(u, v, rng.randrange(0, 9) + high[u] - high[v]) for u, v in ((2 * rng.randrange(13), 2 * rng.randrange(13)) for _ in range(24))]
    edges += [edges[0], (4, 4, -1.0), (2, 8, None), (30, 32, 2.0)]
    both = edges if directed else edges + [(v, u, w) for u, v, w in edges]
    graph = Graph(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(40,), (2,)], "id int"), directed)
    ids = sorted({40, 2, *(u for u, _, _ in edges), *(v for _, v, _ in edges)})
    rows = graph.floyd_warshall(side).collect()
    assert len({(r.src, r.dst) for r in rows}) == len(rows)
    assert {(r.src, r.dst): r.dist for r in rows} == all_pairs(both, ids)


def test_long_ring(spark):
    """2,000 vertices both ways around, in rounds of 256."""
    n = 2000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("weight"))
    found = Graph(ring, directed=False).floyd_warshall()
    gap = F.abs(F.col("src") - F.col("dst"))
    right = F.sum((F.col("dist") == F.least(gap, n - gap)).cast("long")).alias("right")
    assert tuple(found.agg(F.count("*"), right).first()) == (n * n, n * n)


def test_negative_cycle_over_blocks(spark):
    edges = [(v, (v + 1) % 9, 1.0 if v else -9.0) for v in range(9)]
    with pytest.raises(ValueError):
        Graph(spark.createDataFrame(edges, EDGES)).floyd_warshall(2)


def test_no_vertices(spark):
    assert Graph(spark.createDataFrame([], EDGES)).floyd_warshall().collect() == []


def layers(edges, ids):
    """The longest way to each vertex that no cycle leads to."""
    out, left = {}, set(ids)
    while True:
        now = {v for v in left if all(u in out for u, w in edges if w == v)}
        if not now:
            return out
        out |= {v: max((out[u] + 1 for u, w in edges if w == v), default=0) for v in now}
        left -= now


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_of_random_graphs(spark, seed):
    """Trees, joints, long runs, lone vertices, parallels; a cycle, runs into and out of it."""
    rng = random.Random(seed)
    edges = [tuple(sorted(rng.sample(range(14), 2))) for _ in range(14)] + [(v, v + 1) for v in range(20, 40)] + [(40, 3), (5, 20)]
    edges += [edges[0], *((rng.randrange(20, 41), v) for v in range(50, 56))]
    ids = {u for e in edges for u in e} | {99}
    given = lambda pairs: Graph(spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(99,)], "id int"))
    acyclic = [(u, v) for u, v in edges if (u, v) != (40, 3) or seed == 2]
    acyclic = [e for e in acyclic if e != (5, 20)] if seed == 2 else acyclic
    assert {r.id: r.layer for r in given(acyclic).topological().collect()} == layers(set(acyclic), ids)
    back = {(v, u) for u, v in acyclic}
    assert {r.id: r.layer for r in given(acyclic).topological(reverse=True).collect()} == layers(back, ids)
    cyclic = acyclic + [(60, 61), (61, 62), (62, 60), (62, 63), (1, 64), (63, 64)]
    assert {r.id: r.layer for r in given(cyclic)._layers().collect()} == layers(set(cyclic), ids | {60, 61, 62, 63, 64})
    with pytest.raises(ValueError):
        given(cyclic).topological()


def test_layers_of_a_long_chain(spark):
    n = 5000
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert tuple(Graph(chain.repartition(8)).topological().agg(F.count("*"), F.sum((F.col("layer") == F.col("id")).cast("long"))).first()) == (n, n)


def test_only_stored_tables_are_dropped(spark, tmp_path):
    mine = tmp_path / "mine"
    spark.range(3).write.parquet(str(mine))
    drop_stored(spark.read.parquet(str(mine)))
    drop_stored(spark.range(3))
    kept, gone = stored(spark.range(4)), stored(spark.range(5))
    drop_stored(gone)
    assert spark.read.parquet(str(mine)).count() == 3 and kept.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not found"):
        gone.count()


def test_table_rows_are_no_whole_tiles(spark, monkeypatch):
    """Readers take thousands of table rows at a time: of tiles of half a megabyte that was gigabytes."""
    from planimetra.operators import all_pairs as tiles

    widest = []
    real = tiles.stored
    monkeypatch.setattr(tiles, "stored", lambda df: (out := real(df), widest.append(out.agg(F.max(F.size("cells"))).first()[0]) if "cells" in df.columns else None)[0])
    edges = [(k, (k + 1) % 20, 1.0) for k in range(20)]
    graph = Graph(spark.createDataFrame(edges, EDGES))
    found = {(r.src, r.dst): r.dist for r in graph.floyd_warshall(8).collect()}
    assert found == {(a, b): float((b - a) % 20) for a in range(20) for b in range(20)}
    assert widest and max(widest) <= 8
