"""Queries and operators on their whole input, against brute force."""

from __future__ import annotations

import heapq
import os
import random

import pytest
from compare import connect

from planimetra.operators.graph import Graph
from planimetra.plans import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def greatest_matching(edges) -> int:
    """The size, by one augmenting path at a time."""
    beside, mate = {}, {}
    for u, v in set(edges):
        beside.setdefault(u, []).append(v)

    def augment(u, seen) -> bool:
        for v in beside[u]:
            if v not in seen:
                seen.add(v)
                if v not in mate or augment(mate[v], seen):
                    mate[v] = u
                    return True
        return False

    return sum(augment(u, set()) for u in sorted(beside))


def is_matching(rows, edges) -> bool:
    pairs = [(r.u, r.v) for r in rows]
    return set(pairs) <= set(edges) and len({u for u, _ in pairs}) == len(pairs) == len({v for _, v in pairs})


def test_max_matching_takes_several_rounds(spark):
    rng = random.Random(5)
    hot = [(u, 0) for u in range(30)]
    chain = [e for k in range(4) for e in ((100 + k, 100 + k), (100 + k, 101 + k))]
    edges = hot + chain + [(rng.randrange(30), rng.randrange(1, 25)) for _ in range(45)] + [(3, 7)] * 4
    found = Graph(spark.createDataFrame(edges, "src long, dst long")).max_matching().collect()
    assert is_matching(found, edges)
    assert len(found) == greatest_matching(edges)


def test_graph_matching_has_all_parts_and_suppliers(spark, con):
    edges = con.execute("select distinct l_partkey, l_suppkey from lineitem").fetchall()
    found = QUERIES["graph_matching"](spark, SF_DIR).collect()
    assert is_matching(found, edges)
    assert len(found) == greatest_matching(edges)


def least_of_component(vertices, edges) -> dict:
    """Union-find."""
    top = {v: v for v in vertices}

    def find(v):
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {v: find(v) for v in top}


def test_graph_components_all_has_every_line(spark, con, tmp_path):
    lines = [(1, 10, 1.0), (1, 11, 2.0), (2, 11, 50.0), (2, 12, 1.0), (3, 20, 50.0), (3, 21, 49.0), (4, 30, 3.0), (5, 40, 44.0), (5, 40, 44.0)]
    rows = [(o, p, 1, 1, q) for o, p, q in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.id: r.component for r in QUERIES["graph_components_all"](spark, str(tmp_path)).collect()}
    assert found == {10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 30: 30, 40: 40}
    lines = con.execute("select l_orderkey, l_partkey from lineitem order by all").fetchall()
    edges = [(a[1], b[1]) for a, b in zip(lines, lines[1:], strict=False) if a[0] == b[0]]
    found = {r.id: r.component for r in QUERIES["graph_components_all"](spark, SF_DIR).collect()}
    assert found == least_of_component({p for _, p in lines}, edges)


def test_components_of_hubs(spark, monkeypatch):
    from planimetra.operators import graph

    monkeypatch.setattr(graph, "HUB", 8)
    rng = random.Random(6)
    edges = [(rng.choice([5, 700, 900]), rng.randrange(300)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(0, 60, 2)]
    found = {r.id: r.component for r in Graph(spark.createDataFrame(edges, "src long, dst long"), directed=False).connected_components().collect()}
    assert found == least_of_component({x for e in edges for x in e}, edges)


@pytest.fixture(scope="module")
def trade(con) -> dict:
    """(src, dst): weight, of all pairs of nations."""
    rows = con.execute("""select c_nationkey, s_nationkey, count(*) from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2""").fetchall()
    return {(a, b): float(w) for a, b, w in rows}


def nearest(edges: dict, start, cost) -> dict:
    """Dijkstra with a heap."""
    done, heap = {}, [(0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in done:
            done[v] = d
            for (a, b), w in edges.items():
                if a == v and b not in done:
                    heapq.heappush(heap, (d + cost(w), b))
    return done


def test_trade_paths_over_all_pairs(spark, trade):
    dist, level = nearest(trade, 0, lambda w: w), nearest(trade, 0, lambda w: 1)
    rows = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, SF_DIR).collect()}
    assert rows("graph_dijkstra_all") == rows("graph_bellman_ford_all") == dist
    assert rows("graph_dijkstra_pair_all") == ({17: dist[17]} if 17 in dist else {})
    assert rows("graph_a_star_all") == ({11: dist[11]} if 11 in dist else {})
    assert rows("graph_bfs_all") == level
    assert sorted(map(tuple, QUERIES["graph_path_to_all"](spark, SF_DIR).collect())) == sorted((a, b) for a, b in trade if b < a)


def test_trade_walks_and_trees_over_all_pairs(spark, trade):
    order, seen = [], set()

    def visit(v) -> None:
        seen.add(v)
        order.append(v)
        for b in sorted(b for a, b in trade if a == v):
            if b not in seen:
                visit(b)

    visit(0)
    assert [r.id for r in sorted(QUERIES["graph_dfs"](spark, SF_DIR).collect(), key=lambda r: r.ord)] == order
    tree, taken = [], {0}
    while edges := [(w, min(e), max(e)) for e, w in trade.items() if len(taken & set(e)) == 1]:
        tree.append(min(edges))
        taken |= set(tree[-1][1:])
    assert sorted((r.weight, r.src, r.dst) for r in QUERIES["graph_prim"](spark, SF_DIR).collect()) == sorted(tree)


def test_trees_with_all_customers(spark, con):
    below, above = {}, {}
    for node, parent in con.execute("""select * from (select 'r' || r_regionkey, 'w' from region order by r_regionkey) union all
            select * from (select 'n' || n_nationkey, 'r' || n_regionkey from nation order by n_nationkey) union all
            select * from (select 'c' || c_custkey, 'n' || c_nationkey from customer order by c_custkey)""").fetchall():
        below.setdefault(parent, []).append(node)
        above[node] = parent
    for nodes in below.values():
        nodes.sort(key=lambda x: int(x[1:]))
    pre, post, facts = [], [], {}

    def visit(node, depth) -> tuple:
        pre.append(node)
        parts = [visit(x, depth + 1) for x in below.get(node, [])]
        post.append(node)
        height, count = max((h + 1 for h, _, _, _ in parts), default=0), sum(n + 1 for _, n, _, _ in parts)
        facts[node] = (depth, height, count, parts[0][2] if parts else node, parts[-1][3] if parts else node)
        return height, count, *facts[node][3:]

    def up(node) -> list:
        return [node, *(up(above[node]) if node in above else [])]

    visit("w", 0)
    rows = lambda name: QUERIES[name](spark, SF_DIR).collect()
    assert [r.node for r in sorted(rows("tree_preorder_all"), key=lambda r: r.places)] == pre
    assert [r.node for r in sorted(rows("tree_postorder_all"), key=lambda r: r.key)] == post
    assert [r.node for r in sorted(rows("tree_level_order_all"), key=lambda r: (r.depth, r.places))] == sorted(pre, key=lambda x: facts[x][0])
    assert {r.node: (r.depth, r.height, r.descendant_count) for r in rows("tree_compute_all")} == {k: v[:3] for k, v in facts.items()}
    assert {r.node: (r.leaf_left, r.leaf_right) for r in rows("tree_ends_all")} == {k: v[3:] for k, v in facts.items()}
    pairs = [(x, f"c{int(x[1:]) + 1}") for x in pre if x[0] == "c" and f"c{int(x[1:]) + 1}" in facts]
    lca = {(a, b): next(x for x in up(a) if x in up(b)) for a, b in pairs}
    path = {(a, b): ">".join(up(a)[: up(a).index(t) + 1] + up(b)[: up(b).index(t)][::-1]) for (a, b), t in lca.items()}
    assert {(r.a, r.b): r.lca for r in rows("tree_lca_all")} == lca
    assert {(r.a, r.b): r.path for r in rows("tree_find_path_all")} == path


def test_dfs_in_many_rounds(spark, monkeypatch):
    """A part of the graph at a time, with a hub and a long way back."""
    from planimetra.operators import graph

    monkeypatch.setattr(graph, "WALK_EDGES", 6)
    monkeypatch.setattr(graph, "WALK", 4)
    monkeypatch.setattr(graph, "FAN", 2)
    rng = random.Random(11)
    edges = [(0, k) for k in range(1, 7)] + [(k, k + 1) for k in range(6, 10)] + [(rng.randrange(12), rng.randrange(12)) for _ in range(9)] + [(40, 41)]
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    order, seen = [], set()

    def visit(v) -> None:
        seen.add(v)
        order.append(v)
        for w in sorted(out[v]):
            if w not in seen:
                visit(w)

    visit(0)
    found = Graph(spark.createDataFrame(edges, "src long, dst long"), directed=False).dfs(0).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.ord)] == order and [r.ord for r in sorted(found, key=lambda r: r.ord)] == list(range(len(order)))
