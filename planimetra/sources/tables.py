"""Geometry, graphs and hierarchies derived from the driver's relational tables, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y of every line item (quantity, price); no key."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: hundredths of customer keys and balances."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") / 100).alias("x"), (F.col("c_acctbal") / 100).alias("y"))


def part_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, xmin, ymin, xmax, ymax around size and price of every part."""
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (x - 0.25).alias("xmin"), (y - 0.3).alias("ymin"), (x + 0.25).alias("xmax"), (y + 0.3).alias("ymax"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and ten numbers a to j for each customer, spread over small ranges without ties."""
    k, u = F.col("c_custkey"), F.col("c_acctbal") / 9973
    number = lambda m, c: ((k % m).cast("double") + u * c)
    return table(spark, sf_dir, "customer").select(k.alias("id"), *(number(m, c).alias(n) for n, m, c in SHAPE_NUMBERS))


#: name, modulus and factor of each number: (key % modulus) + factor * balance / 9973.
SHAPE_NUMBERS = (("a", 13, 0.71), ("b", 11, 0.37), ("c", 7, 1.13), ("d", 17, 0.53), ("e", 5, 0.91), ("f", 19, 0.29), ("g", 3, 0.83), ("h", 23, 0.41), ("i", 29, 0.67), ("j", 2, 0.59))
SHAPES_SQL = "s as (select c_custkey as id, " + ", ".join(f"(c_custkey % {m})::double + (c_acctbal / 9973) * {c}::double as {n}" for n, m, c in SHAPE_NUMBERS) + " from customer)"


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: lines between customers' and suppliers' nations, all pairs of two."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight between neighbouring nation keys and within regions: fixed at any scale."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("ra"))
    b = n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("rb"))
    rows = a.join(b, F.col("ra") == F.col("rb")).where("src < dst")
    return rows.select("src", "dst", ((F.col("src") * 7 + F.col("dst") * 13) % 19 + 1).cast("double").alias("weight"))


NATION_EDGES_SQL = """ne as (select a.n_nationkey as src, b.n_nationkey as dst, ((a.n_nationkey * 7 + b.n_nationkey * 13) % 19 + 1)::double as weight
    from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: parts that follow each other in an order's lines; undirected."""
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    rows = rows.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))


PART_EDGES_SQL = """pe as (select src, dst from (select l_partkey as src,
    lead(l_partkey) over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) as dst
    from lineitem) where dst is not null and src <> dst)"""


def turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each turn of a conversation and the next, named `conv_id/turn`."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("src"), "conv_id", "turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("dst", F.lead("src").over(w)).where("dst is not null").select("src", "dst", F.lit(1.0).alias("weight"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, ord: world, regions, nations, customers."""
    t = lambda n: table(spark, sf_dir, n)
    root = spark.range(1).select(F.lit("w").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("ord"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = t("region").select(name("r", "r_regionkey"), F.lit("w"), F.col("r_regionkey").cast("long"))
    nations = t("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.col("n_nationkey").cast("long"))
    customers = t("customer").select(name("c", "c_custkey"), name("n", "c_nationkey"), F.col("c_custkey").cast("long"))
    return root.union(regions).union(nations).union(customers)


TREE_SQL = """t as (select 'w' as node, null::varchar as parent, 0::bigint as ord
    union all select 'r' || r_regionkey, 'w', r_regionkey::bigint from region
    union all select 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::bigint from nation
    union all select 'c' || c_custkey, 'n' || c_nationkey, c_custkey from customer)"""


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, ord, x, y: a customer's orders by time; x counts them, y is the price, scaled so that no value is a rounding tie."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select(F.col("o_custkey").alias("path_id"), F.row_number().over(w).cast("long").alias("ord"), F.col("o_totalprice").alias("price"))
    return rows.select("path_id", "ord", (F.col("ord") * 10).cast("double").alias("x"), (F.col("price") / 997).alias("y"))


PATHS_SQL = """p as (select o_custkey as path_id, row_number() over w as ord, (row_number() over w * 10)::double as x, o_totalprice / 997 as y
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))"""


def write_spatial(df: DataFrame, path: str, slices: int = 64) -> None:
    """Boxes as Parquet, laid out so that searches skip row groups."""
    from ..operators.spatial import str_layout

    str_layout(df, slices).write.mode("overwrite").parquet(path)
