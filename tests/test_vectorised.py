"""Functions that once took milliseconds a row: results on odd input, and that many rows take seconds."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from planimetra.functions import bezier, polygon
from planimetra.functions import rect as rc
from planimetra.functions import vector as v
from planimetra.operators import overlay


def seconds(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def curves(df, *numbers):
    p = [v.point(F.col(numbers[k]), F.col(numbers[k + 1])) for k in range(0, 8, 2)]
    return df.withColumn("k", bezier.curve(*p))


def test_even_spacing_of_many_curves(spark):
    """Three milliseconds a curve made this a minute in one task."""
    x = [(F.sin(F.col("id") * (k + 1)) * 9).alias(f"c{k}") for k in range(8)]
    df = curves(spark.range(0, 20_000, 1, 1).select("id", *x), *[f"c{k}" for k in range(8)])
    assert seconds(df.select(bezier.even_ts(F.col("k"), 4), bezier.tangent_at_length(F.col("k"), 5.0))) < 20


def test_even_spacing_of_odd_curves(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0), (2, None, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0), (3, nan, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0), (4, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0), (5, inf, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0, 0.0)]
    df = curves(spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, f double, g double, h double"), *"abcdefgh")
    found = {r.id: r for r in df.select("id", bezier.even_ts(F.col("k"), 3).alias("ts"), bezier.tangent_at_length(F.col("k"), F.when(F.col("id") == 4, 0.0).otherwise(1.5)).alias("t")).collect()}
    assert found[1].ts == pytest.approx([0, 1 / 3, 2 / 3, 1]) and (found[1].t.x, found[1].t.y) == (1, 0)
    assert found[2].ts == found[4].ts == [0, 0, 0, 1]
    assert found[3].ts == found[5].ts == [1, 1, 1, 1]
    none = df.select(bezier.even_ts(F.when(F.col("id") > 9, F.col("k")), 2).alias("ts"), bezier.tangent_at_length(F.col("k"), F.lit(None).cast("double")).alias("t")).where("id = 1").first()
    assert none.ts == [0, 0, 1] and (none.t.x, none.t.y) == (1, 0)
    assert df.limit(0).select(bezier.even_ts(F.col("k"), 3)).count() == 0


def wrapped(points):
    """Corners by Andrew's chain in plain Python."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out = []
    for side in (points, points[::-1]):
        half = []
        for q in side:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (q[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (q[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(q)
        out += half[:-1]
    return out


def test_hulls_and_cuts_of_many_points(spark):
    """35 milliseconds a row made this two minutes."""
    at = lambda k: v.point(F.sin(F.col("id") * (k + 1)) * 9, F.cos(F.col("id") * (k + 2)) * 9)
    p = F.array(*map(at, range(5)))
    df = spark.range(0, 4_000, 1, 1).select("id", polygon.hull(p).alias("hull"), polygon.clip_to_rect(p, rc.rect(-3, -3, 4, 4)).alias("cut"))
    assert seconds(df.select(polygon.area(F.col("hull")), polygon.area(F.col("cut")))) < 20


def test_hulls_of_grid_points(spark):
    rng = random.Random(5)
    sets = [[(float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(rng.randrange(0, 14))] for _ in range(120)] + [[(1.0, 1.0)] * 4, [(float(k), float(k)) for k in range(6)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(sets)], "id int, p array<struct<x: double, y: double>>")
    for r in df.select("id", polygon.hull(F.col("p")).alias("h")).collect():
        assert [(q.x, q.y) for q in r.h] == wrapped(sets[r.id])
    assert math.isclose(df.where("id = 120").select(polygon.area(polygon.hull(F.col("p")))).first()[0], 0.0)


def test_overlays_of_many_pairs(spark):
    """Rings joined one by one, and pairs that a side parts, made this half a minute in one task."""
    x, y = F.sin(F.col("id")) * 2, F.cos(F.col("id") * 3) * 2
    diamond = lambda x, y: F.array(v.point(x - 1, y), v.point(x, y - 1), v.point(x + 1, y), v.point(x, y + 1))
    df = spark.range(0, 100_000, 1, 1).select("id", x.alias("x"), y.alias("y"), diamond(F.lit(0.0), F.lit(0.0)).alias("p"), diamond(x, y).alias("q"))
    assert seconds(overlay.overlay(df, "p", "q")) < 10
    u, w = F.abs(F.col("x") + F.col("y")), F.abs(F.col("x") - F.col("y"))
    want = F.greatest(F.lit(0.0), 2 - u) * F.greatest(F.lit(0.0), 2 - w) / 2
    wrong = overlay.overlay(df, "p", "q").where((F.abs(F.col("area") - want) > 1e-9) | (F.size("rings") != (F.col("area") > 0).cast("int")))
    assert wrong.where(want > 1e-6).isEmpty() and wrong.where("area > 1e-6").isEmpty()


def test_parted_outlines_and_those_that_only_seem_so(spark):
    """A concave outline around a box that its own sides' lines would part, boxes that share a side or a corner."""
    box = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]
    hook = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 4.0), (3.0, 1.0), (0.0, 1.0)]
    pairs = [(hook, box(2.5, 0.5), 0.75), (hook, box(3.5, 2.0), 0.5), (hook, box(1.0, 1.0), 0.0), (hook, box(2.5, 2.0), 0.5), (box(0.0, 0.0), box(1.0, 0.0), 0.0), (box(0.0, 0.0), box(1.0, 1.0), 0.0), (box(0.0, 0.0), box(0.0, 0.0), 1.0)]
    df = spark.createDataFrame([(k, p, q) for k, (p, q, _) in enumerate(pairs)], "id int, p array<struct<x: double, y: double>>, q array<struct<x: double, y: double>>")
    for r in overlay.overlay(df, "p", "q").collect():
        assert r.area == pytest.approx(pairs[r.id][2]) and len(r.rings) == (r.area > 0)
