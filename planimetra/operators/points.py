"""Point sets with repeats and snapping."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spatial import distance_join

#: Width of a cell as a share of the tolerance: all points of one cell are within tolerance of each other.
SIDE = 0.707
#: Points of one cell that a join meets in one part.
HUB = 10_000
#: Rounds after which the undecided points are settled in one task, if they are at most REST.
ROUNDS, REST = 12, 100_000


def counted(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x, y, n: the distinct points and how often each occurs; points with NaN are left out."""
    return df.where(~F.isnan(x) & ~F.isnan(y)).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def repeated(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return counted(df, x, y).where("n > 1")


def coordinates(points: DataFrame, include_repeated: bool = False) -> DataFrame:
    """The points of counted(); each as often as it occurs, if wanted."""
    rows = points.select("x", "y", "n")
    return rows.select("x", "y", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).drop("k") if include_repeated else rows.drop("n")


def at(points: DataFrame, x: float, y: float) -> DataFrame:
    return points.where((F.col("x") == x) & (F.col("y") == y))


def best_match(probes: DataFrame, points: DataFrame, tolerance: float, probe: str = "probe") -> DataFrame:
    """For each probe (probe, px, py) the nearest of the points within tolerance; ties go to the lesser (x, y)."""
    pairs = distance_join(probes, points.select("x", "y", "n"), tolerance, "px", "py", "x", "y")
    return pairs.groupBy(probe).agg(F.min(F.struct("d2", "x", "y", "n")).alias("m")).select(probe, "m.x", "m.y", "m.n", "m.d2")


def _greedy(points: DataFrame, tolerance: float) -> DataFrame:
    """The representatives among at most REST points (o, x, y, cx, cy), one by one."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        kept: dict[tuple[int, int], tuple[float, float]] = {}  # a cell has one at most
        rows = []
        for o, x, y, cx, cy in group.sort_values(["o", "x", "y"])[["o", "x", "y", "cx", "cy"]].itertuples(index=False):
            near = (kept.get((cx + i, cy + j)) for i in range(-2, 3) for j in range(-2, 3))
            if all(q is None or (q[0] - x) ** 2 + (q[1] - y) ** 2 > tolerance * tolerance for q in near):
                kept[cx, cy] = x, y
                rows.append((o, x, y, cx, cy))
        return pd.DataFrame(rows, columns=["o", "x", "y", "cx", "cy"])

    columns = ["o", "x", "y", "cx", "cy"]
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in columns)
    return points.select(*columns).groupBy(F.lit(1).alias("one")).applyInPandas(settle, kinds)


def snapped(df: DataFrame, tolerance: float, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """x, y, n: points taken in the order of `order` (ties: the lesser (x, y)); one within
    tolerance of an earlier representative adds to the count of the nearest such (ties: the
    lesser), else it is a representative. Points with a null or NaN are left out.

    Distinct points are decided in rounds. The first undecided point of a cell is a
    representative if it comes before those of all cells that its tolerance can reach; then
    what is within tolerance of a new one is decided too. A cell is so small that it has one
    representative at most, so nothing is joined to more than 25 of them, however dense the
    cloud, and the points of a full cell are dealt into parts. Orders that run along a chain of
    points decide few in a round: what is left after ROUNDS is settled one by one if it is at
    most REST points, else the rounds go on.
    """
    side, reach = tolerance * SIDE, tolerance * tolerance
    rows = df.select(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    rows = rows.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    own, cell = F.struct("o", "x", "y"), ["cx", "cy"]
    parts = cut(rows.groupBy(*cell).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"))
    one_or = F.coalesce("parts", F.lit(1))
    apart = lambda q: (q["x"] - F.col("x")) ** 2 + (q["y"] - F.col("y")) ** 2

    def dealt(points: DataFrame) -> DataFrame:
        return points.join(parts, cell, "left").withColumn("part", F.pmod(F.xxhash64("o", "x", "y"), one_or).cast("int")).drop("parts")

    def around(points: DataFrame) -> DataFrame:
        """p in each cell that its tolerance can reach."""
        beside = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)).alias(c)
        return points.select("p", beside("cx"), "cy").select("p", "cx", beside("cy"))

    def joined(points: DataFrame, kept: DataFrame) -> DataFrame:
        """points with near, the representatives that may be within tolerance."""
        near = around(kept).groupBy(*cell).agg(F.collect_list("p").alias("near"))
        near = near.join(parts, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one_or - 1))).drop("parts")
        return points.join(near, [*cell, "part"], "left")

    def within(near: Column) -> Column:
        return F.coalesce(F.exists(near, lambda q: apart(q) <= reach), F.lit(False))

    left, kept, done = cut(dealt(rows.groupBy(*cell, "x", "y").agg(F.min("o").alias("o")))), None, 0
    while kept is None or not left.isEmpty():
        if done >= ROUNDS and left.limit(REST + 1).count() <= REST:
            kept = kept.union(cut(_greedy(left, tolerance)).select(own.alias("p"), *cell))
            break
        heads = cut(left.groupBy(*cell).agg(F.min(own).alias("p")))
        first = around(heads).groupBy(*cell).agg(F.min("p").alias("first"))
        new = cut(heads.join(first, cell).where("p = first").select("p", *cell))
        kept = new if kept is None else kept.union(new)
        left = cut(joined(left, new).where(~within(F.col("near"))).select(*left.columns))
        done += 1
    earlier = F.filter("near", lambda q: (apart(q) <= reach) & (q <= own))
    best = F.array_min(F.transform(earlier, lambda q: F.struct(apart(q).alias("d2"), q["x"].alias("x"), q["y"].alias("y"))))
    return joined(dealt(rows), kept).select(best.alias("b")).groupBy("b.x", "b.y").agg(F.count("*").alias("n"))


#: Points of one group that a task holds before it drops those inside their hull.
HELD = 50_000


def _hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the convex hull, counter-clockwise from the least point; none along a side."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = np.diff(x) != 0
    end = np.flatnonzero(np.append(new[1:], True))  # of the points above each other only the lowest and highest matter
    keep = np.unique(np.concatenate([np.flatnonzero(new), end]))
    points = list(dict.fromkeys(zip(x[keep].tolist(), y[keep].tolist())))
    if len(points) < 3:
        chain = points
    else:
        chain = []
        for way in (points, points[::-1]):
            half: list[tuple[float, float]] = []
            for q in way:
                while len(half) > 1 and (half[-1][0] - half[-2][0]) * (q[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (q[0] - half[-2][0]):
                    half.pop()
                half.append(q)
            chain += half[:-1]
    return np.array([a for a, _ in chain], float), np.array([b for _, b in chain], float)


def hulls(df: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """group, hull (its corners, counter-clockwise from the least point): one row for each group.

    Each task keeps the hulls of what it has read of each group, and a group's partial hulls meet
    in the end, so that only corners move. One or two distinct points, or points on a line, leave
    the line's ends. Points with null or non-finite coordinates are left out; null is a group.
    """
    kind = df.schema[group].dataType.simpleString()
    finite = (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))
    rows = df.where(finite).select(F.col(group).alias("group"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (np.zeros(0), np.zeros(0)))
        schema = None
        for batch in batches:
            schema = batch.schema
            coded = batch.column(0).dictionary_encode()
            numbers = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            names = [*coded.dictionary.to_pylist(), None]
            xs, ys = (batch.column(k).to_numpy() for k in (1, 2))
            for n in np.unique(numbers):
                own = numbers == n
                px, py = held[names[n]]
                px, py = np.concatenate([px, xs[own]]), np.concatenate([py, ys[own]])
                held[names[n]] = _hull(px, py) if len(px) > HELD else (px, py)
        for name, points in held.items():
            px, py = _hull(*points)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(px), schema.field(0).type), pa.array(px), pa.array(py)], ["group", "x", "y"])

    def whole(table: pa.Table) -> pa.Table:
        px, py = _hull(table["x"].to_numpy(), table["y"].to_numpy())
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        return pa.table({"group": table["group"][:1], "hull": pa.array([[{"x": a, "y": b} for a, b in zip(px.tolist(), py.tolist())]], pa.list_(point))})

    parts = rows.mapInArrow(partial, f"group {kind}, x double, y double")
    return parts.groupBy("group").applyInArrow(whole, f"group {kind}, hull array<struct<x: double, y: double>>").withColumnRenamed("group", group)
