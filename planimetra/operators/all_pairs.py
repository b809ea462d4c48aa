"""Distances of all pairs by square tiles of their matrix.

A tile (i, j) holds the distances from the i-th to the j-th block of vertices. One round for each
block k closes the tile (k, k), then those beside it in row and column k, and sends these to the
tiles that they meet: a task has three tiles at a time, whatever the graph's size, and each round
writes the matrix once. A tile in which nothing is reached has no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored
from .ordered import placed

#: Vertices of a block: a tile of 256 x 256 distances takes half a megabyte.
SIDE = 256
#: A tile is kept as its rows r, as readers take thousands of table rows at a time; low is the least
#: distance from a vertex of a diagonal tile to itself.
_TILE = "i int, j int, r int, cells array<double>, low double"


def _close(cells: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """cells with every way that goes through one of the middle vertices of left and right, in place;
    with cells as both it closes a tile, as each step uses the ones before."""
    for m in range(len(cells)):
        reach = left[:, m]
        if np.isfinite(reach).any():
            np.minimum(cells, reach[:, None] + right[m], out=cells)
    return cells


def _rows(i: int, j: int, cells: np.ndarray | None) -> pd.DataFrame:
    """The rows of a tile in which something is reached."""
    if cells is None or not (some := np.flatnonzero(np.isfinite(cells).any(1))).size:
        return pd.DataFrame({"i": [], "j": [], "r": [], "cells": pd.Series([], dtype=object), "low": []})
    return pd.DataFrame({"i": i, "j": j, "r": some, "cells": [cells[r] for r in some], "low": float(cells.diagonal().min()) if i == j else 0.0})


def _square(group: pd.DataFrame, side: int) -> np.ndarray | None:
    """The tile of these rows, None without any."""
    if not len(group):
        return None
    cells = np.full((side, side), np.inf)
    cells[group["r"].to_numpy()] = np.stack(group["cells"].to_numpy())
    return cells


def _filler(side: int):
    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells = np.full(side * side, np.inf)
        cells[group["at"].to_numpy()] = group["dist"].to_numpy()
        return _rows(*key, cells.reshape(side, side))

    return fill


def _beside(side: int, k: int):
    """A tile of row or column k by way of the closed tile (k, k)."""

    def beside(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells, pivot = (_square(group[group["role"] == role], side) for role in ("own", "pivot"))
        _close(pivot, pivot, pivot)
        if key == (k, k):
            return _rows(*key, pivot)
        if cells is None:  # the pivot is sent to all, also where nothing is reached
            return _rows(*key, None)
        left, right = (pivot, cells.copy()) if key[0] == k else (cells.copy(), pivot)
        return _rows(*key, _close(cells, left, right))

    return beside


def _meeting(side: int):
    """A tile by way of those of its row and its column that were sent to it."""

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells, left, right = (_square(group[group["role"] == role], side) for role in ("own", "left", "right"))
        if left is not None and right is not None:
            cells = _close(np.full((side, side), np.inf) if cells is None else cells, left, right)
        return _rows(*key, cells)

    return meet


def distances(vertices: DataFrame, edges: DataFrame, side: int = SIDE) -> DataFrame:
    """src, dst, dist of all pairs of vertices(id) that edges(src, dst, weight) lead from one to the
    other; 0 to itself. Weights may be negative, a negative cycle raises; loops and edges without
    a weight aren't used. Rounds are the vertices over `side`."""
    ids = stored(placed(vertices.select("id").distinct(), "id").select("id", (F.col("place") - 1).alias("p")))
    n = ids.count()
    side = max(1, min(side, n))
    place = lambda end, name: ids.select(F.col("id").alias(end), F.col("p").alias(name))
    ways = edges.where("src <> dst and weight is not null").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("dist"))
    ways = ways.join(place("src", "p"), "src").join(place("dst", "q"), "dst").select("p", "q", "dist")
    ways = ways.union(ids.select("p", "p", F.lit(0.0)))
    block = lambda c: F.floor(F.col(c) / side).cast("int")
    cells = ways.select(block("p").alias("i"), block("q").alias("j"), (F.col("p") % side * side + F.col("q") % side).cast("int").alias("at"), "dist")
    tiles = stored(cells.groupBy("i", "j").applyInPandas(_filler(side), _TILE))
    blocks = -(-n // side)
    for k in range(blocks):
        new = stored(_round(tiles, k, blocks, side))
        drop_stored(tiles)
        tiles = new
        if not tiles.where("low < 0").isEmpty():
            raise ValueError("Graph contains a negative weight cycle.")
    far = tiles.select("i", "j", "r", F.posexplode("cells").alias("at", "dist")).where(F.col("dist") < float("inf"))
    far = far.select((F.col("i").cast("long") * side + F.col("r")).alias("p"), (F.col("j").cast("long") * side + F.col("at")).alias("q"), "dist")
    return far.join(place("src", "p"), "p").join(place("dst", "q"), "q").select("src", "dst", "dist")


def _spread(tiles: DataFrame, count: int) -> DataFrame:
    """tiles over tasks by their places. They take long for their bytes, by which adaptive execution
    would merge tasks, so the number is given: some 16 tiles a task, fewer while cores are idle."""
    idle = 2 * tiles.sparkSession.sparkContext.defaultParallelism
    return tiles.repartition(max(min(count, idle), count // 16), "i", "j")


def _round(tiles: DataFrame, k: int, blocks: int, side: int) -> DataFrame:
    """The tiles once ways may go through block k."""
    in_row, in_column = F.col("i") == k, F.col("j") == k
    to = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    at_k = F.lit(k)
    beside = F.concat(F.transform(every, lambda t: to(at_k, t, "pivot")), F.transform(F.filter(every, lambda t: t != k), lambda t: to(t, at_k, "pivot")))
    pivot = tiles.where(in_row & in_column).select("r", "cells", F.explode(beside).alias("to")).select("to.i", "to.j", "to.role", "r", "cells")
    near = tiles.where(in_row | in_column).select("i", "j", F.lit("own").alias("role"), "r", "cells").union(pivot)
    panel = _spread(near, 2 * blocks - 1).groupBy("i", "j").applyInPandas(_beside(side, k), _TILE)
    others = F.filter(every, lambda t: t != k)
    own = F.array(to(F.col("i"), F.col("j"), "own"))
    down = F.transform(others, lambda t: to(t, F.col("j"), "right"))
    across = F.transform(others, lambda t: to(F.col("i"), t, "left"))
    sent = panel.select("r", "cells", F.explode(F.when(in_row & in_column, own).when(in_row, F.concat(own, down)).otherwise(F.concat(own, across))).alias("to"))
    rest = tiles.where(~in_row & ~in_column).select("i", "j", F.lit("own").alias("role"), "r", "cells")
    return _spread(rest.union(sent.select("to.i", "to.j", "to.role", "r", "cells")), blocks * blocks).groupBy("i", "j").applyInPandas(_meeting(side), _TILE)
