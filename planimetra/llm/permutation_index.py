"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its M nearest pivots in order. The pivots' inverted files hold
which vectors name them, and at which place; a query reads the files of its own M pivots and so
gets the footrule distance of its order to that of every vector with a pivot in common. The
SHARE of vectors with the least distances is ranked anew by exact inner products.

For inner products of vectors whose lengths differ, each is given one more component that brings
it to the greatest length, and queries a zero: the least angle is then the largest product.

Equal vectors are one entry with their least ids: no query can want more of them than it returns.
Entries are dealt into blocks by hash, each with inverted files of its own, and queries visit all
blocks in blocks of their own; every block returns the nearest it has for each query. So no pivot's
file grows with a hot region of the space, and no task holds more than a block of each kind.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do null ids; of rows that agree in the id, the one with the greatest vector (component by
component) takes part; shorter vectors count as ending in zeros; queries with fewer than K
candidates get all; equal scores go by the id; a table without usable rows gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import hubs, join_split, materialise, stored

K, EVERY = 20, 20
#: Pivots are PIVOTS distinct vectors (those with the least hashes; all, if there are fewer): what
#: the index is fitted on. An entry is posted to the files of its M nearest.
PIVOTS, M = 1024, 64
#: The share of entries whose exact product is taken, and how many at least (over all blocks).
SHARE, LEAST = 1 / 8, 2048
#: A block has at most about BLOCK entries; in smaller tables there are BLOCKS.
BLOCK, BLOCKS = 65_536, 16
#: Queries in a block of queries, about.
QUERIES = 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vector (of doubles) of the rows that take part; one for each id."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """entry, key, ids (the k + 1 least), vector: a row for each distinct vector."""
    same = Window.partitionBy("key", "vector").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    nodes = least.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(nodes.withColumn("entry", F.monotonically_increasing_id()))


def _flat(column: pa.Array, dims: int) -> np.ndarray:
    """A row for each list, with zeros to its right."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each row, in order; equally near ones in theirs."""
    out = np.empty((len(x), m), np.int64)
    for at in range(0, len(x), 4096):
        far = -(x[at : at + 4096] @ pivots.T)
        near = np.sort(np.argpartition(far, m - 1, axis=1)[:, :m], axis=1)
        order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
        out[at : at + 4096] = np.take_along_axis(near, order, 1)
    return out


def _lengthened(x: np.ndarray, greatest: float) -> np.ndarray:
    """Scaled so that all have length one, by a further component."""
    x = x / greatest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))[:, None]])


class Files:
    """The inverted files of one block of vectors: for each pivot, who names it and at which place."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, greatest: float, m: int = M) -> None:
        self.x, self.pivots, self.m = x, pivots, min(m, len(pivots))
        named = _nearest(_lengthened(x, greatest), pivots, self.m)
        by_pivot = np.argsort(named, axis=None, kind="stable")
        self.who, self.place = by_pivot // self.m, by_pivot % self.m
        self.start = np.searchsorted(named.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.slack = 1e-9 * float(np.abs(x).max())

    def orders(self, queries: np.ndarray) -> np.ndarray:
        return _nearest(queries, self.pivots[:, :-1], self.m)

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Half of how far the footrule distance to each vector stays below its greatest value.

        A pivot that an order doesn't name stands at place m. The distance is then m (m + 1),
        less 2 (m - the larger of the two places) for each pivot that both name.
        """
        first, size = self.start[order], np.diff(self.start)[order]
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        gain = self.m - np.maximum(self.place[at], np.repeat(np.arange(self.m), size))
        return np.bincount(self.who[at], gain, len(self.x))

    def search(self, query: np.ndarray, order: np.ndarray, rerank: int, k: int) -> np.ndarray:
        """The k nearest (and those that rounding may have put behind them) among the `rerank`
        vectors of least footrule distance and those at the same distance as the last."""
        found = np.arange(len(self.x))
        if rerank < len(found):
            near = self.agreement(order)
            found = np.flatnonzero(near >= np.partition(near, -rerank)[-rerank])
        about = self.x[found] @ query
        if k < len(found):
            found = found[about >= np.partition(about, -k)[-k] - self.slack * np.abs(query).sum()]
        return found

    def products(self, found: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Inner products of pairs, one component after the other, whatever the block."""
        score = np.zeros(len(found))
        for d in range(self.x.shape[1]):
            score += self.x[found, d] * queries[:, d]
        return score


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The k nearest of each query (a row whose id `every` divides): query_id, rank, vec_id, score."""
    v = F.col("vector")
    rows = stored(usable(vectors, id_col, vector).withColumn("key", F.concat(F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector")))))
    nodes = entries(rows, k)
    n, dims, greatest = nodes.agg(F.count("*"), F.max(F.size("vector")), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = nodes.orderBy("key").select(v).limit(PIVOTS).toArrow().column(0).combine_chunks()
    pivots = _lengthened(_flat(sample, dims), greatest)

    blocks = max(BLOCKS, -(-n // BLOCK))
    rerank = max(share, min(1.0, least / n))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key", "vector")
    asked = stored(join_split(asked, nodes.select("key", F.col("entry").alias("asked")), "key", "query_id", hubs(asked, "key")).drop("key"))
    wanted = materialise(asked.dropDuplicates(["asked"]).select("asked", "vector"))
    groups = max(1, -(-wanted.count() // QUERIES))

    def built(table: pa.Table) -> pa.Table:
        """A block as one row."""
        table = table.combine_chunks()
        x = _flat(table["vector"].combine_chunks(), dims)
        columns = {"block": pa.array([table["block"][0].as_py()], pa.int32()), "ids": pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "xs": pa.array([x.ravel()], pa.list_(pa.float64()))}
        return pa.table(columns)

    def gathered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        q = _flat(table["vector"].combine_chunks(), dims)
        return pa.table({"asked": pa.array([table["asked"].to_numpy()], pa.list_(pa.int64())), "qs": pa.array([q.ravel()], pa.list_(pa.float64()))})

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, files = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(0)[row].as_py()
                if block != last:  # rows come sorted by block
                    files = Files(batch.column(2)[row].values.to_numpy().reshape(-1, dims), pivots, greatest)
                    last, ids = block, batch.column(1)[row].values
                names = batch.column(3)[row].values.to_numpy()
                queries = batch.column(4)[row].values.to_numpy().reshape(-1, dims)
                most = int(np.ceil(rerank * len(files.x)))
                found = [files.search(query, order, most, k + 1) for query, order in zip(queries, files.orders(queries))]
                of, at = np.repeat(np.arange(len(queries)), [len(f) for f in found]), np.concatenate(found)
                score = files.products(at, queries[of])
                yield pa.RecordBatch.from_arrays([pa.array(names[of]), ids.take(pa.array(at)), pa.array(score)], ["asked", "ids", "score"])

    index = stored(nodes.select(F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block"), "ids", "vector").groupBy("block").applyInArrow(built, "block int, ids array<array<long>>, xs array<double>"))
    queries = wanted.select(F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int").alias("group"), "asked", "vector").groupBy("group").applyInArrow(gathered, "asked array<long>, qs array<double>")
    visits = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = index.join(visits, "block").sortWithinPartitions("block").select("block", "ids", "xs", "asked", "qs")
    hits = pairs.mapInArrow(searched, "asked long, ids array<long>, score double")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    best = hits.select("asked", "score", F.explode("ids").alias("vec_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = materialise(best.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list")))
    mine = join_split(asked.select("query_id", "asked"), lists, "asked", "query_id", hubs(asked, "asked"))
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(own).alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
