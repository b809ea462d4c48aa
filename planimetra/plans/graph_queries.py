"""Queries over graphs and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.ordered import placed
from ..operators.tree import Tree
from ..session import cut, stored
from ..sources import tables as tb
from .registry import query, r4


def _trade(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    return Graph(tb.trade_pairs(spark, sf_dir), directed=directed)


def _nations(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(tb.nation_edges(spark, sf_dir), directed=False)


def _parts(spark: SparkSession, sf_dir: str) -> Graph:
    rows = tb.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return Graph(tb.part_edges(spark, sf_dir), rows, directed=False)


_BOTH = "both_ways as (select src, dst, weight from ne union all select dst, src, weight from ne)"
# distances over all trade pairs come from as many relaxations of all edges as there are nations
_TRADE_ALL = """trade as materialized (select c_nationkey as src, s_nationkey as dst, count(*)::double as weight from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2)"""


def _relaxed(edges: str, start: str, step: str, rounds: int) -> str:
    """SQL of the least values (id, d) that start at `start` and grow by `step` along the edges t, as table d<rounds>."""
    tables = [f"with {edges}, d0 as materialized ({start})"]
    tables += [f"d{k + 1} as materialized (select id, min(d) as d from (select id, d from d{k} union all select t.dst, {step} from d{k} w join trade t on w.id = t.src) group by id)" for k in range(rounds)]
    return ", ".join(tables)


_SSSP = _relaxed(_TRADE_ALL, "select 0 as id, 0::double as d", "w.d + t.weight", 25) + " select id, d as dist from d25"


@query(f"with {tb.NATION_EDGES_SQL}, {_BOTH} select src as id, count(*) as degree from both_ways group by 1")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).degrees()


@query(f"with {tb.NATION_EDGES_SQL}, {_BOTH} select src, dst, weight from both_ways")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).edges


@query(f"with {tb.NATION_EDGES_SQL}, {_BOTH}, more as (select * from both_ways union all select 0, 99, 5::double union all select 99, 0, 5::double) select src, dst, weight from more where src % 5 <> 2 and dst % 5 <> 2")
def graph_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge to a new vertex is added, every fifth vertex is removed."""
    g = _nations(spark, sf_dir)
    g = g.add_edges(spark.range(1).select(F.lit(0).alias("src"), F.lit(99).alias("dst"), F.lit(5.0).alias("weight")))
    return g.remove_vertices(g.vertices.where("id % 5 = 2")).edges


@query(f"with {_TRADE_ALL} select src, dst from trade where dst < src")
def graph_path_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _trade(spark, sf_dir)
    pairs = g.vertices.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("dst")).where("dst < src")
    return g.paths_to(pairs)


@query(_SSSP)
def graph_dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).distances(0).select("id", "dist")


@query(f"select * from ({_SSSP}) where id = 17")
def graph_dijkstra_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).dijkstra_pair(0, 17).select("id", "dist")


@query(_SSSP)
def graph_bellman_ford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).bellman_ford_distances(0).select("id", "dist")


@query(f"select * from ({_SSSP}) where id = 11")
def graph_a_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).a_star(0, 11).select("id", "dist")


_APSP = f"""with recursive {tb.NATION_EDGES_SQL}, {_BOTH}, v as (select distinct src as id from both_ways),
    walk(src, dst, dist, hops) as (select id, id, 0::double, 0 from v union
    select * from (select w.src, e.dst, w.dist + e.weight, w.hops + 1 from walk w join both_ways e on w.dst = e.src where w.hops < 4))
    select src, dst, min(dist) as dist from walk group by src, dst"""


@query(_APSP)
def graph_floyd_warshall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).floyd_warshall()


@query(_APSP)
def graph_johnson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).johnson().select(F.col("source").alias("src"), F.col("id").alias("dst"), r4(F.col("dist")).alias("dist"))


_LEVELS = _relaxed(_TRADE_ALL, "select 0 as id, 0 as d", "w.d + 1", 25) + " select id, d as level from d25"


@query(_LEVELS)
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).bfs(0).select("id", "level")


# the same under other names


@query(f"with {_TRADE_ALL} select src, dst from trade where dst < src")
def graph_path_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _trade(spark, sf_dir)
    ids = g.vertices
    return g.paths_to(ids.select(F.col("id").alias("src")).join(ids.select(F.col("id").alias("dst")), F.col("dst") < F.col("src")))


@query(_SSSP)
def graph_dijkstra_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).distances(0).select("id", "dist")


@query(f"select * from ({_SSSP}) where id = 17")
def graph_dijkstra_pair_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).dijkstra_pair(0, 17).select("id", "dist")


@query(_SSSP)
def graph_bellman_ford_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).bellman_ford_distances(0).select("id", "dist")


@query(f"select * from ({_SSSP}) where id = 11")
def graph_a_star_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).a_star(0, 11).select("id", "dist")


@query(_LEVELS)
def graph_bfs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).bfs(0).select("id", "level")


@query()
def graph_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).dfs(0)


# labels spread by one edge in each round; the graph of parts is random and dense, so few rounds settle it
_PARTS_ALL = f"""trade as materialized (with {tb.PART_EDGES_SQL} select src, dst from pe union select dst, src from pe)"""
_COMPONENTS = _relaxed(_PARTS_ALL, "select distinct l_partkey as id, l_partkey as d from lineitem", "w.d", 24) + " select id, d as component from d24"


@query(_COMPONENTS)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).connected_components()


@query(_COMPONENTS)
def graph_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_components(spark, sf_dir)


@query("select 'trade' as graph, true as cyclic union all select 'turns', false union all select 'nations', true")
def graph_is_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [("trade", _trade(spark, sf_dir).is_cyclic()), ("turns", Graph(tb.turn_edges(spark, sf_dir)).is_cyclic()), ("nations", _nations(spark, sf_dir).is_cyclic())]
    return spark.createDataFrame(found, "graph string, cyclic boolean")


@query("select conv_id || '/' || turn as id, (row_number() over (partition by conv_id order by turn) - 1)::int as layer from conversations where conv_id in (select conv_id from conversations group by conv_id having count(*) > 1)")
def graph_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(tb.turn_edges(spark, sf_dir)).topological()


@query("select conv_id || '/' || turn as id, (row_number() over (partition by conv_id order by turn desc) - 1)::int as layer from conversations where conv_id in (select conv_id from conversations group by conv_id having count(*) > 1)")
def graph_topological_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(tb.turn_edges(spark, sf_dir)).topological(reverse=True)


# an edge is in the least spanning forest if no path of lighter edges joins its ends
_MST = f"""with recursive {tb.NATION_EDGES_SQL}, n as (select row_number() over (order by weight, src, dst) as k, src, dst, weight from ne),
    r(k, id) as (select k, src from n union select r.k, case when n.src = r.id then n.dst else n.src end from r join n on n.k < r.k and r.id in (n.src, n.dst))
    select src, dst, weight from n where not exists (select 1 from r where r.k = n.k and r.id = n.dst)"""


@query(_MST)
def graph_kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).kruskal()


@query(f"select sum(weight) as cost, count(*) as edges from ({_MST}) where src % 5 = (select n_nationkey % 5 from nation where n_nationkey = 0) or src >= 0")
def graph_forest_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).spanning_forest().agg(F.sum("weight").alias("cost"), F.count("*").alias("edges"))


_TRADE_MST = _MST.replace(tb.NATION_EDGES_SQL, """ne as (select least(c_nationkey, s_nationkey) as src, greatest(c_nationkey, s_nationkey) as dst, min(w)::double as weight from (
    select c_nationkey, s_nationkey, count(*) as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2) group by 1, 2)""")


@query(_TRADE_MST)
def graph_prim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir, directed=False).prim(0)


# the greatest flow is the least cut: one bit for each other nation of the source's region
_CUTS = f"""with {tb.NATION_EDGES_SQL}, v as (select n_nationkey as k, row_number() over (order by n_nationkey) - 1 as bit from nation where n_regionkey = (select n_regionkey from nation where n_nationkey = 0) and n_nationkey not in (0, 20)),
    cuts as (select unnest(range((1 << (select count(*) from v))::bigint)) as s), side as (select s, k, ((s >> bit) & 1) = 1 as inside from cuts, v union all select s, 0, true from cuts),
    cost as (select cuts.s, coalesce(sum(weight) filter (where a.inside and not coalesce(b.inside, false)), 0) as cost from cuts left join side a on a.s = cuts.s left join ne on ne.src = a.k left join side b on b.s = cuts.s and b.k = ne.dst group by 1)
    select min(cost)::bigint as flow from cost"""


@query(_CUTS)
def graph_max_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Graph(tb.nation_edges(spark, sf_dir)).max_flow(0, 20)
    return spark.createDataFrame([(flow,)], "flow long")


def _weighed(graph: Graph, source, sink) -> DataFrame:
    """flow, cut (the capacity of the least cut) and unbalanced (inner vertices that don't pass on what they get)."""
    flows, side = graph.push_relabel(source, sink)
    ends = flows.select(F.col("src").alias("id"), (-F.col("flow")).alias("net")).union(flows.select("dst", "flow")).groupBy("id").agg(F.sum("net").alias("net"))
    sums = ends.agg(F.coalesce(F.sum(F.when(F.col("id") == F.lit(sink), F.col("net"))), F.lit(0)).alias("flow"), F.count(F.when(~F.col("id").isin(source, sink) & (F.col("net") != 0), 1)).alias("unbalanced"))
    out = graph.edges.join(side.select(F.col("id").alias("src")), "src", "left_semi").join(side.select(F.col("id").alias("dst")), "dst", "left_anti")
    return sums.join(out.agg(F.coalesce(F.sum(F.col("weight").cast("long")), F.lit(0)).alias("cut")).hint("broadcast")).select("flow", "cut", "unbalanced")


@query(_CUTS.replace("select min(cost)::bigint as flow from cost", "select min(cost)::bigint as flow, min(cost)::bigint as cut, 0::bigint as unbalanced from cost"))
def graph_push_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(Graph(tb.nation_edges(spark, sf_dir)), 0, 20)


@query()
def graph_supply_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines half of each supplier's parts can fill, two a part: over all pairs of supplier and part."""
    # suppliers are even numbers, parts odd ones; whole numbers take less room than names
    own = lambda key, rest: (2 * F.col(key).cast("long") + rest)
    pairs = stored(tb.table(spark, sf_dir, "lineitem").select(own("l_suppkey", 0).alias("src"), own("l_partkey", 1).alias("dst")).distinct())
    start, end = -(2**63), 2**63 - 1
    supply = pairs.groupBy(F.col("src").alias("dst")).agg(F.floor(F.count("*") / 2).alias("weight")).select(F.lit(start).alias("src"), "dst", "weight")
    demand = pairs.select(F.col("dst").alias("src")).distinct().select("src", F.lit(end).alias("dst"), F.lit(2).cast("long").alias("weight"))
    return _weighed(Graph(pairs.withColumn("weight", F.lit(1).cast("long")).unionByName(supply).unionByName(demand)), start, end)


@query()
def graph_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return Graph(rows).max_matching()


_PART_STEPS = f"""with recursive {tb.PART_EDGES_SQL}, e as (select src, dst from pe union select dst, src from pe), ends as (select min(src) as a, max(src) as b from e),
    r(id, d) as (select a, 0 from ends union select e.dst, d + 1 from r join e on e.src = r.id where d < 12)
    select a as start, b as goal, min(d)::double as dist from ends join r on r.id = b group by all"""


@query(_PART_STEPS)
def graph_a_star_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of the first and the last part in the graph of all parts, with landmarks for the estimate."""
    graph = Graph(stored(tb.part_edges(spark, sf_dir)), tb.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), directed=False)
    graph.vertices = stored(graph.vertices)
    first, last = graph.given.agg(F.least(F.min("src"), F.min("dst")), F.greatest(F.max("src"), F.max("dst"))).first()
    found = graph.a_star(first, last, graph.landmark_bounds(last, 2))
    return found.select(F.lit(first).alias("start"), F.lit(last).alias("goal"), "dist")


# a distance and its number of edges as one number, so that the least has the fewest edges of equal ones
_PART_WAYS = _relaxed(f"""trade as materialized (with {tb.PART_EDGES_SQL} select src, dst, ((src + dst) % 17 + 1) * 100000 + 1 as weight from (select src, dst from pe union select dst, src from pe))""", "select min(l_partkey) as id, 0::bigint as d from lineitem", "w.d + t.weight", 30) + """,
    ways as materialized (select v.id, v.d, min(u.id) as before from d30 v left join (trade t join d30 u on u.id = t.src) on t.dst = v.id and u.d + t.weight = v.d and v.d > 0 group by v.id, v.d)"""


def _weighed_parts(spark: SparkSession, sf_dir: str) -> tuple[Graph, int]:
    """Parts that follow each other in orders, with weights of 1 to 17, and the least part."""
    edges = tb.part_edges(spark, sf_dir).withColumn("weight", ((F.col("src") + F.col("dst")) % 17 + 1).cast("double"))
    rows = tb.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return Graph(edges, rows, directed=False), rows.agg(F.min("id")).first()[0]


@query(f"{_PART_WAYS} select id, (d // 100000)::double as dist, (d % 100000)::int as hops, before from ways")
def graph_distances_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the least part to all parts."""
    graph, first = _weighed_parts(spark, sf_dir)
    return graph.distances(first)


@query(f"""{_PART_WAYS}, back as (with recursive r(id, before, d) as (select id, before, d from ways where d = (select max(d) from ways) and id = (select min(id) from ways where d = (select max(d) from ways))
    union all select w.id, w.before, w.d from r join ways w on w.id = r.before) select * from r)
    select (d % 100000 - 1)::int as place, before as src, id as dst, ((before + id) % 17 + 1)::double as weight from back where before is not null""")
def graph_farthest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path to the part that is farthest from the least one, an edge a row."""
    graph, first = _weighed_parts(spark, sf_dir)
    found = cut(graph.distances(first))
    goal = found.orderBy(F.desc("dist"), F.desc("hops"), "id").limit(1).select("id")
    return graph.path_to(found, goal).select(F.posexplode("path").alias("place", "e")).select("place", "e.*")


@query("""with o as (select o_custkey as c, o_orderkey as k, floor(o_totalprice) as w, o_orderdate from orders)
    select 'o' || k as id, sum(w) over (partition by c order by o_orderdate, k) as dist, (row_number() over (partition by c order by o_orderdate, k))::int as hops from o union all select 'start', 0, 0""")
def graph_distances_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one start to every customer's first order, and on to the next: prices add up along runs."""
    orders = tb.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = F.concat(F.lit("o"), F.col("o_orderkey"))
    edges = orders.select(F.coalesce(F.lag(name).over(w), F.lit("start")).alias("src"), name.alias("dst"), F.floor("o_totalprice").alias("weight"))
    return Graph(edges).distances("start").select("id", "dist", "hops")


_SUPPLY_STEPS = """d0 as materialized (with se as (select src, dst, w from (select l_suppkey as src, lead(l_suppkey) over o as dst, l_quantity as w from lineitem
    window o as (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity)) where dst is not null and src <> dst)
    select src, dst, min(w)::double as dist from (select * from se union all select l_suppkey, l_suppkey, 0 from lineitem) group by 1, 2)"""
_SUPPLY_PAIRS = "with " + ", ".join([_SUPPLY_STEPS] + [f"d{k + 1} as materialized (select a.src, b.dst, min(a.dist + b.dist) as dist from d{k} a join d{k} b on a.dst = b.src group by 1, 2)" for k in range(8)])


@query(f"{_SUPPLY_PAIRS} select src, dst, dist from d8")
def graph_all_pairs_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of suppliers; one leads to the next in an order's lines, by the first one's quantity."""
    lines = tb.table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    steps = lines.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"), F.col("l_quantity").alias("weight"))
    return Graph(steps.where("dst is not null and src <> dst"), lines.select(F.col("l_suppkey").alias("id"))).floyd_warshall()


@query("""with o as (select o_orderkey as id, row_number() over (order by o_orderdate, o_orderkey) - 1 as n from orders)
    select id, n::int as layer from o""")
def graph_topological_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of all orders, each before the next in time: one chain as long as the table."""
    orders = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    at = cut(placed(orders, "o_orderdate", "id"))
    after = at.select(F.col("id").alias("dst"), (F.col("place") - 1).alias("place"))
    return Graph(at.join(after, "place").select(F.col("id").alias("src"), "dst"), at.select("id")).topological()


# hierarchies

_REC = f"""with recursive {tb.TREE_SQL}, rel(node, parent, depth, path, key) as (select node, parent, 0, [node], []::bigint[] from t where parent is null
    union all select t.node, t.parent, depth + 1, list_append(path, t.node), list_append(key, t.ord) from rel join t on t.parent = rel.node)"""
_CLOSURE = _REC + ", c as (select unnest(path) as top, node, depth from rel)"


def _tree(spark: SparkSession, sf_dir: str) -> Tree:
    return Tree(tb.hierarchy(spark, sf_dir))


@query(f"{_REC} select node, depth from rel")
def tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).depths()


@query(f"{_CLOSURE} select r.node, (max(c.depth) - max(r.depth))::int as height from c join rel r on r.node = c.top group by r.node")
def tree_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).heights()


@query(f"with {tb.TREE_SQL} select node from t where node not in (select parent from t where parent is not null)")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).leaves()


@query(f"{_CLOSURE} select top as node, count(*) - 1 as descendant_count, count(case when node not in (select parent from t where parent is not null) then 1 end) as leaf_count from c group by top")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).counts()


@query(f"{_CLOSURE}, val as (select 'c' || c_custkey as node, c_acctbal as value from customer) select top as node, round(coalesce(sum(value), 0), 2) + 0 as total from c left join val on val.node = c.node group by top")
def tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = tb.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_acctbal").alias("value"))
    return _tree(spark, sf_dir).sums(values).select("node", (F.round("total", 2) + F.lit(0.0)).alias("total"))


@query(f"{_REC} select node, unnest(list_reverse(path)) as ancestor, unnest(range(0, depth + 1))::int as steps from rel where node in ('c1', 'c2', 'n3', 'w')")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).ancestors(spark.createDataFrame([("c1",), ("c2",), ("n3",), ("w",)], "node string")).select("node", "ancestor", "steps")


_PAIRS = "pr as (select 'c' || c_custkey as a, 'c' || (c_custkey + 1) as b from customer union all select 'c1', 'w' union all select 'n1', 'n1')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and the next, and two pairs of inner nodes."""
    return _all_pairs(spark, sf_dir).union(spark.createDataFrame([("c1", "w"), ("n1", "n1")], "a string, b string"))


_LCA = f"{_REC}, {_PAIRS} select a, b, list_filter(pa.path, lambda x: list_contains(pb.path, x))[-1] as lca from pr join rel pa on pa.node = a join rel pb on pb.node = b"


@query(_LCA)
def tree_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).lca(_pairs(spark, sf_dir))


_FIND_PATH = f"{_REC}, {_PAIRS} select a, b, array_to_string(list_concat(list_reverse(list_filter(pa.path, lambda x: not list_contains(pb.path, x))), [list_filter(pa.path, lambda x: list_contains(pb.path, x))[-1]], list_filter(pb.path, lambda x: not list_contains(pa.path, x))), '>') as path from pr join rel pa on pa.node = a join rel pb on pb.node = b"


@query(_FIND_PATH)
def tree_find_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).find_path(_pairs(spark, sf_dir)).select("a", "b", F.array_join("path", ">").alias("path"))


@query(f"{_REC} select node, depth from rel where depth = 2")
def tree_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).at_depth(2)


@query(f"with {tb.TREE_SQL} select parent, node as child from t where parent is not null")
def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).links()


# a traversal's order is that of the places on the way down; ranks of all nodes would need one task
_PLACED = f"""with recursive {tb.TREE_SQL}, o as (select *, row_number() over (partition by parent order by ord, node) as place from t), rel(node, depth, places) as (select node, 0, []::bigint[] from o where parent is null
    union all select o.node, depth + 1, list_append(places, o.place) from rel join o on o.parent = rel.node)"""


def _joined(key: str):
    return F.array_join(F.transform(key, lambda x: x.cast("string")), ".").alias(key)


@query(f"{_PLACED} select node, array_to_string(places, '.') as places from rel")
def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).preorder().select("node", _joined("places"))


@query(f"{_PLACED} select node, array_to_string(list_append(places, 2147483647), '.') as key from rel")
def tree_postorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).postorder().select("node", _joined("key"))


@query(f"{_PLACED} select node, depth, array_to_string(places, '.') as places from rel")
def tree_level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).level_order().select("node", "depth", _joined("places"))


@query(f"{_PLACED} select node, row_number() over (order by places) - 1 as preorder, row_number() over (order by list_append(places, 2147483647)) - 1 as postorder, row_number() over (order by depth, places) - 1 as level_order from rel")
def tree_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).ranks()


@query(f"{_REC} select node, depth from rel where node like '%7' order by depth, key limit 12")
def tree_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).find(F.col("node").endswith("7"), 12)


@query(f"{_CLOSURE} select node from rel where not list_contains(path, 'r1') and not list_contains(path, 'n3')")
def tree_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).remove(spark.createDataFrame([("r1",), ("n3",)], "node string")).depths().select("node")


@query(f"with {tb.TREE_SQL} select parent, node, row_number() over (partition by parent order by c_acctbal desc, node) as place from t join customer on node = 'c' || c_custkey")
def tree_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = tb.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (-F.col("c_acctbal")).alias("ord"))
    nodes = tb.hierarchy(spark, sf_dir).drop("ord").join(balance, "node")
    return Tree(nodes).nodes.select("parent", "node", F.col("place").cast("long").alias("place"))


_ENDS = f"{_REC}, l as (select path, key, node from rel where node not in (select parent from t where parent is not null)), x as (select unnest(path) as top, key, node from l) select top as node, arg_min(node, key) as leaf_left, arg_max(node, key) as leaf_right from x group by top"


@query(_ENDS)
def tree_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).ends()


@query(f"with {tb.TREE_SQL}, k as (select parent as node, count(*) as child_count, arg_min(node, ord) as first_child, arg_max(node, ord) as last_child from t where parent is not null group by 1) select t.node, coalesce(child_count, 0) as child_count, first_child, last_child, (row_number() over (partition by parent order by ord) - 1)::int as place from t left join k on t.node = k.node")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).children()


@query("select 'c' || c_custkey as node, 3 as depth from customer where c_nationkey = (select min(n_nationkey) from nation where n_regionkey = 0 and n_nationkey in (select c_nationkey from customer)) order by c_custkey limit 1")
def tree_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).deepest()


@query(f"{_REC} select node, not (list_contains(path, 'r2') and not list_contains(path, 'n8')) as expand from rel")
def tree_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).expanded(spark.createDataFrame([("r2", False), ("n8", True)], "node string, expand boolean"))


_COMPUTE = f"{_CLOSURE}, a as (select top as node, count(*) - 1 as descendant_count, max(depth) as deepest from c group by top) select rel.node, rel.depth, (deepest - rel.depth)::int as height, descendant_count from rel join a on a.node = rel.node"


@query(_COMPUTE)
def tree_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).compute().select("node", "depth", "height", "descendant_count")


# pairs of customers only, and traversals whose sort keys are arrays


def _all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and the next."""
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    return tb.table(spark, sf_dir, "customer").select(name(F.col("c_custkey")).alias("a"), name(F.col("c_custkey") + 1).alias("b"))


@query(_LCA.replace(" union all select 'c1', 'w' union all select 'n1', 'n1'", ""))
def tree_lca_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).lca(_all_pairs(spark, sf_dir))


@query(_FIND_PATH.replace(" union all select 'c1', 'w' union all select 'n1', 'n1'", ""))
def tree_find_path_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).find_path(_all_pairs(spark, sf_dir)).select("a", "b", F.array_join("path", ">").alias("path"))


@query()
def tree_preorder_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).preorder()


@query()
def tree_postorder_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).postorder()


@query()
def tree_level_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).level_order()


@query(_ENDS)
def tree_ends_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).ends()


@query(_COMPUTE)
def tree_compute_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).compute().select("node", "depth", "height", "descendant_count")
