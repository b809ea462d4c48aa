"""What searches and flows leave behind, and what they work out once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from planimetra.operators import graph as graphs
from planimetra.operators.graph import Graph


def test_flow_keeps_one_rounds_tables(spark):
    """Each round left the whole graph in the folder."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    kept = lambda: {p for p in folder.glob("*/*")}
    edges = [(0, 1, 3), (0, 2, 2), (1, 3, 2), (2, 3, 3), (1, 2, 1), (3, 4, 4)]
    graph = Graph(spark.createDataFrame(edges, "src long, dst long, weight long"))
    before = kept()
    flows, side = graph.push_relabel(0, 4)
    assert len(kept() - before) <= 2  # the edges, and what leads to the sink
    assert flows.where("dst = 4").agg(F.sum("flow")).first()[0] == 4
    assert 0 in {r.id for r in side.collect()}


def test_searches_of_a_graph_share_its_edges(spark, monkeypatch):
    """A search with landmarks worked out the lightest edges for each of them anew."""
    made, worked = [], []
    lightest = Graph._lightest
    monkeypatch.setattr(Graph, "_lightest", lambda self, edges=None: (worked.append(1) if edges is not None else None, lightest(self, edges))[1])
    monkeypatch.setattr(graphs, "stored", lambda df, real=graphs.stored: (made.append(tuple(df.columns)), real(df))[1])
    edges = [(k, (k * k + 1) % 17, 1.0) for k in range(17)] + [(k, k + 1, 1.0) for k in range(16)]
    graph = Graph(spark.createDataFrame(edges, "src long, dst long, weight double"), directed=False)
    found = graph.a_star(0, 16, graph.landmark_bounds(16, 2)).first()
    near = {k: {b for a, b, _ in edges if a == k} | {a for a, b, _ in edges if b == k} for k in range(17)}
    level, front = 0, {0}
    while 16 not in front:
        level, front = level + 1, front | {b for a in front for b in near[a]}
    assert found.dist == level == len(found.path)
    assert len(worked) == 1
    assert made.count(("id", "a", "b")) <= 4  # once of all, then without the ends of each search
