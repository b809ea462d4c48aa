"""Queries over spatial indexes, point sets and ordered multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rect as rc
from ..operators import ordered, spatial
from ..operators import points as pts
from ..sources import tables as tb
from .registry import query, r4

_POINTS = "pt as (select l_quantity as x, l_extendedprice as y from lineitem)"
_CUST = "cp as (select c_custkey as id, c_custkey / 100 as x, c_acctbal / 100 as y from customer)"
_RECTS = "re as (select p_partkey as id, p_size - 0.25::double as xmin, p_retailprice - 0.3::double as ymin, p_size + 0.25::double as xmax, p_retailprice + 0.3::double as ymax from part)"
_MEET = "a.xmin <= b.xmax and a.xmax >= b.xmin and a.ymin <= b.ymax and a.ymax >= b.ymin"


@query(f"with {_POINTS} select count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from pt where x >= 10 and x <= 20 and y >= 10000 and y <= 20000")
def search_points_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.search_points(tb.points(spark, sf_dir), 10, 10000, 20, 20000, closed=True)
    return found.agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


@query(f"with {_POINTS} select x, y, count(*) as n from pt where x >= 10 and x < 12 and y >= 10000 and y < 20000 group by all")
def search_points_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.counted(spatial.search_points(tb.points(spark, sf_dir), 10, 10000, 12, 20000))


@query(f"with {_RECTS} select id, xmin, ymin, xmax, ymax from re where xmin <= 20 and xmax >= 10 and ymin <= 940 and ymax >= 910")
def search_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.search(tb.part_rects(spark, sf_dir), 10, 910, 20, 940)


@query(f"with {_RECTS} select id, xmin, ymin, xmax, ymax from re where xmin <= 20 and xmax >= 10 and ymin <= 940 and ymax >= 910 and id % 7 = 3 order by id limit 1")
def search_single_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.search_single(tb.part_rects(spark, sf_dir), 10, 910, 20, 940, F.col("id") % 7 == 3, "id")


@query(f"with {_RECTS} select k, exists (select 1 from re where xmin <= k + 1 and xmax >= k and ymin <= 905 and ymax >= 900) as hit from range(0, 60, 10) q(k)")
def collides_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.range(0, 60, 10).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x0"), F.lit(900.0).alias("y0"), (F.col("id") + 1).cast("double").alias("x1"), F.lit(905.0).alias("y1"))
    hit = spatial.spatial_join(probes, tb.part_rects(spark, sf_dir), 4.0, "left_semi", ("x0", "y0", "x1", "y1"))
    return probes.select("k").join(hit.select("k", F.lit(True).alias("hit")), "k", "left").select("k", F.coalesce("hit", F.lit(False)).alias("hit"))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = tb.part_rects(spark, sf_dir)
    return r.toDF("a", "ax0", "ay0", "ax1", "ay1"), r.toDF("b", "bx0", "by0", "bx1", "by1")


@query(f"with {_RECTS} select a.id as a, b.id as b from re a join re b on a.id < b.id and {_MEET}")
def spatial_join_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return spatial.spatial_join(a, b, 1.0, "inner", ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), refine=F.col("a") < F.col("b")).select("a", "b")


@query(f"with {_RECTS} select a.id as a from re a where exists (select 1 from re b where a.id <> b.id and {_MEET})")
def spatial_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return spatial.spatial_join(a, b, 1.0, "left_semi", ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), refine=F.col("a") != F.col("b")).select("a")


@query(f"with {_RECTS} select a.id as a from re a where not exists (select 1 from re b where a.id <> b.id and {_MEET})")
def spatial_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return spatial.spatial_join(a, b, 1.0, "left_anti", ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), refine=F.col("a") != F.col("b")).select("a")


@query(f"""with {_RECTS} select id, case when id % 5 = 0 then xmin + 1 else xmin end as xmin, ymin, case when id % 5 = 0 then xmax + 1 else xmax end as xmax, ymax from re where id % 3 <> 0
    union all select -p_partkey, 0, 0, 1, 1 from part where p_partkey <= 10""")
def index_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove (every third), update (every fifth of the rest) and add."""
    rows = tb.part_rects(spark, sf_dir)
    kept = rows.join(rows.where("id % 3 = 0").select("id"), "id", "left_anti")
    moved = kept.withColumns({c: F.when(F.col("id") % 5 == 0, F.col(c) + 1).otherwise(F.col(c)) for c in ("xmin", "xmax")})
    added = rows.where("id <= 10").select((-F.col("id")).alias("id"), F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("xmax"), F.lit(1.0).alias("ymax"))
    return moved.unionByName(added)


@query(f"""with {_RECTS}, b as (select *, lead(xmin) over w as x0, lead(ymin) over w as y0, lead(xmax) over w as x1, lead(ymax) over w as y1 from re window w as (order by id)) select id,
    round((xmax - xmin) * (ymax - ymin), 4) + 0 as area, round(xmax - xmin + ymax - ymin, 4) + 0 as margin,
    round((greatest(xmax, x1) - least(xmin, x0)) * (greatest(ymax, y1) - least(ymin, y0)), 4) + 0 as union_area,
    round(greatest(0, least(xmax, x1) - greatest(xmin, x0)) * greatest(0, least(ymax, y1) - greatest(ymin, y0)), 4) + 0 as common_area,
    xmin <= x0 and ymin <= y0 and x1 <= xmax and y1 <= ymax as contains, xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0 as intersects
    from b where x0 is not null""")
def rect_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = tb.part_rects(spark, sf_dir).toDF("next_id", "x0", "y0", "x1", "y1")
    keys = tb.part_rects(spark, sf_dir).select("id")
    pairs = keys.withColumn("next_id", F.col("id") + 1)  # part keys are consecutive
    rows = tb.part_rects(spark, sf_dir).join(pairs, "id").join(following, "next_id")
    r, s = rc.rect("xmin", "ymin", "xmax", "ymax"), rc.rect("x0", "y0", "x1", "y1")
    return rows.select("id", r4(rc.area(r)).alias("area"), r4(rc.margin(r)).alias("margin"), r4(rc.union_area(r, s)).alias("union_area"), r4(rc.intersection_area(r, s)).alias("common_area"), rc.contains(r, s).alias("contains"), rc.intersects(r, s).alias("intersects"))


@query(f"with {_RECTS} select floor((xmin + xmax) / 2 / 8)::bigint as cell_x, floor((ymin + ymax) / 2 / 20)::bigint as cell_y, count(*) as n, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from re group by 1, 2")
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tb.part_rects(spark, sf_dir)
    cell = lambda a, b, side: F.floor((F.col(a) + F.col(b)) / 2 / side)
    return r.groupBy(cell("xmin", "xmax", 8).alias("cell_x"), cell("ymin", "ymax", 20).alias("cell_y")).agg(F.count("*").alias("n"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query(f"with {_CUST} select id, x, y from cp order by (x - 7.5::double) * (x - 7.5::double) + (y - 20) * (y - 20), id limit 1")
def find_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(tb.customer_points(spark, sf_dir), 7.5, 20).select("id", "x", "y")


@query(f"with {_CUST} select id, x, y from cp where (x - 7.5::double) * (x - 7.5::double) + (y - 20) * (y - 20) <= 100")
def search_in_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.search_circle(tb.customer_points(spark, sf_dir), 7.5, 20, 10)


@query(f"with {_CUST}, sp as (select s_suppkey as sid, s_suppkey / 10 as sx, s_acctbal / 100 as sy from supplier), d as (select sid, id, (x - sx) * (x - sx) + (y - sy) * (y - sy) as d2 from cp, sp), k as (select sid, id, d2, row_number() over (partition by sid order by d2, id) as rank from d) select sid, id, rank, round(d2, 4) + 0 as d2 from k where rank <= 3")
def knn_join_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") / 10).alias("sx"), (F.col("s_acctbal") / 100).alias("sy"))
    rows = spatial.knn_join(probes, tb.customer_points(spark, sf_dir), 3, 2.0, "sid", "id", "sx", "sy", "x", "y")
    return rows.select("sid", "id", F.col("rank").cast("long").alias("rank"), r4(F.col("d2")).alias("d2"))


@query(f"with {_CUST} select a.id as a, b.id as b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 4) + 0 as d2 from cp a join cp b on a.id < b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25::double")
def distance_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.customer_points(spark, sf_dir)
    pairs = spatial.distance_join(c.toDF("a", "ax", "ay"), c.toDF("b", "bx", "by"), 0.5, "ax", "ay", "bx", "by")
    return pairs.where("a < b").select("a", "b", r4(F.col("d2")).alias("d2"))


@query(f"with {_POINTS}, e as (select floor(min(x)) as x0, floor(min(y)) as y0, greatest(max(x) - floor(min(x)), max(y) - floor(min(y))) as m from pt), s as (select x0, y0, pow(2, floor(log2(m)) + 1) as side from e) select floor((x - x0) * (16 / side))::bigint as cell_x, floor((y - y0) * (16 / side))::bigint as cell_y, count(*) as n, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from pt, s group by 1, 2")
def quad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cells(tb.points(spark, sf_dir), 4)


@query(f"with {_POINTS} select x, y, count(*) as n from pt group by x, y having count(*) > 1")
def repeated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.repeated(tb.points(spark, sf_dir))


@query(f"with {_POINTS} select count(*) as nodes, sum(n)::bigint as points, max(n) as most from (select count(*) as n from pt group by x, y)")
def point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.counted(tb.points(spark, sf_dir)).agg(F.count("*").alias("nodes"), F.sum("n").alias("points"), F.max("n").alias("most"))


@query(f"with {_POINTS} select x, y from pt")
def point_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.coordinates(pts.counted(tb.points(spark, sf_dir)), include_repeated=True)


@query(f"with {_CUST}, probe as (select s_suppkey as probe, s_suppkey / 10 as px, s_acctbal / 100 as py from supplier), d as (select probe, x, y, (x - px) * (x - px) + (y - py) * (y - py) as d2 from cp, probe), k as (select *, row_number() over (partition by probe order by d2, x, y) as rn from d where d2 <= 1) select probe, x, y from k where rn = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("probe"), (F.col("s_suppkey") / 10).alias("px"), (F.col("s_acctbal") / 100).alias("py"))
    return pts.best_match(probes, pts.counted(tb.customer_points(spark, sf_dir)), 1.0).select("probe", "x", "y")


@query(f"with {_CUST} select x, y, count(*) as n from cp where x = 0.5::double and y = (select c_acctbal / 100 from customer where c_custkey = 50) group by all")
def exact_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tb.table(spark, sf_dir, "customer").where("c_custkey = 50").select((F.col("c_acctbal") / 100).alias("y"))
    return pts.counted(tb.customer_points(spark, sf_dir).where("x = 0.5").join(own, "y", "left_semi"))


@query()
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.snapped(tb.customer_points(spark, sf_dir), 0.2, "id")


# ordered multisets and heaps


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def heap_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10")
def heap_pops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.head(tb.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, "o_totalprice", "o_orderkey")


@query("select min(o_totalprice) as least, max(o_totalprice) as greatest, count(*) as size from orders")
def ordered_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders")
    return o.agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("greatest"), F.count("*").alias("size"))


@query("select l_quantity as q, (row_number() over (order by l_quantity)) as place from lineitem")
def ordered_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.placed(tb.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q")), "q")


@query("select distinct p_size from part where p_size::double in (select l_quantity from lineitem)")
def ordered_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tb.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("k"))
    probes = tb.table(spark, sf_dir, "part").select("p_size", F.col("p_size").cast("double").alias("k")).distinct()
    return ordered.contains(keys, "k", probes).select("p_size")


@query("select q, count(*) as n from (select l_quantity as q from lineitem except all select p_size::double from part) group by q")
def ordered_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tb.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"))
    gone = tb.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("q"))
    return ordered.remove_one(keys, gone).groupBy("q").agg(F.count("*").alias("n"))


@query("select 'key' as by_what, true as valid union all select 'price', false")
def ordered_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tb.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    key = ordered.is_ordered(o, "o_orderkey", "o_orderkey", "o_custkey").withColumn("by_what", F.lit("key"))
    return key.union(ordered.is_ordered(o, "o_orderkey", "o_totalprice", "o_custkey").withColumn("by_what", F.lit("price"))).select("by_what", "valid")


# of the points above each other only the lowest and the highest can be corners, and they are where no two others have them below
_HULLS = """with g as (select l_returnflag || l_linestatus as kind, l_quantity as x, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by all),
    under as (select distinct m.kind, m.x, m.high as y from g m join g a on a.kind = m.kind and a.x < m.x join g b on b.kind = m.kind and b.x > m.x where (m.high - a.high) * (b.x - a.x) <= (b.high - a.high) * (m.x - a.x)),
    over as (select distinct m.kind, m.x, m.low as y from g m join g a on a.kind = m.kind and a.x < m.x join g b on b.kind = m.kind and b.x > m.x where (m.low - a.low) * (b.x - a.x) >= (b.low - a.low) * (m.x - a.x))
    select kind, x, y from (select kind, x, high as y from g except select * from under union select * from (select kind, x, low as y from g except select * from over))"""


@query(_HULLS)
def point_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the convex hulls of all lines' quantities and prices, by their flags."""
    rows = tb.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return pts.hulls(rows, "kind").select("kind", F.inline("hull"))
