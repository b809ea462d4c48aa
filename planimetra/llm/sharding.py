"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are numbered where they lie and cut into blocks of BLOCK rows (larger ones if a table
would have more than BLOCKS, so that what the driver draws is bounded). How many rows each block sends to each shard is drawn exactly: the matrix has the joint law that a uniform
permutation of all rows would give, its row sums are the blocks' sizes and its column sums
the shards' sizes, which differ by at most one. Each block then permutes its rows and deals
them by its row of the matrix, the rows are exchanged, and each shard permutes what it got.

A shard may hold a sixteenth of all rows, so it is permuted in parts of about BLOCK rows:
rows take a part at random, and a running sum of the parts' counts gives each part's first
slot. Only the blocks' counts meet on the driver.

Defined cases: a null text has no bytes and CRC 0; equal rows and equal ids are rows of
their own; a very long text moves nowhere, as only its size and CRC do; an empty table gives
no rows; a table smaller than the number of shards leaves the last shards empty. All columns
are carried along as they are; if there is a shard or slot among them, the new ones are named
_shard or _slot.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fresh, materialise, small_or_not, text_or_empty

SHARDS, SEED = 16, 20
#: Rows in a block, and about as many in a part of a shard; about the most blocks.
BLOCK, BLOCKS = 50_000, 16_384


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, taken from good + bad without replacement, are good.

    Inverts one uniform number, visiting outcomes from the mode outwards, so the work follows
    the standard deviation. Works for any size that fits a double's logarithm.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    below = above = mode
    p_below = p_above = at_mode
    while left > 0 and (below > low or above < high):
        if below > low:
            p_below *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            left -= p_below
            if left <= 0:
                return below
        if above < high:
            p_above *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            left -= p_above
            if left <= 0:
                return above
    return mode


def communication_matrix(blocks: list[int], shards: int = SHARDS, seed: int = SEED) -> list[list[int]]:
    """For each block's size, the rows that it sends to each shard."""
    rng, total = random.Random(seed), sum(blocks)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in blocks:
        row, left, others = [], size, sum(room)
        for s in range(shards):
            others -= room[s]
            row.append(hypergeometric(rng, room[s], others, left))
            left -= row[-1]
        room = [r - x for r, x in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """df with the further columns shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    df is written to the checkpoint folder once, so that rows keep their numbers even if
    executors are lost; select the columns to carry beforehand.
    """
    spark = df.sparkSession
    uid, at, rank, dealt, part, first, shard, slot = fresh(df, "_uid", "_block", "_rank", "_dealt", "_part", "_first", "shard", "slot")
    rows = materialise(df.withColumn(uid, F.monotonically_increasing_id()))
    total = rows.count()
    block = max(block, -(-total // BLOCKS))
    rows = rows.withColumn(at, F.expr(f"{uid} div {block}"))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(at).count().collect())
    ends = []
    for (b, _), row in zip(counts, communication_matrix([n for _, n in counts], shards, seed), strict=True):
        upto, sums = 0, []
        for n in row[:-1]:
            upto += n
            sums.append(upto)
        ends.append((b, sums))
    matrix = spark.createDataFrame(ends, f"{at} long, {dealt} array<long>")
    if len(ends) * shards <= 1_000_000:  # 8 MB
        matrix = F.broadcast(matrix)
    locally = Window.partitionBy(at).orderBy(F.xxhash64(uid, F.lit(seed)), uid)
    parts = max(1, -(-total // (shards * block)))
    placed = rows.withColumn(rank, F.row_number().over(locally) - 1).join(matrix, at).withColumn(shard, F.size(F.filter(dealt, lambda end: end <= F.col(rank))))
    placed = placed.withColumn(part, F.pmod(F.xxhash64(uid, F.lit(seed + 1)), F.lit(parts)))
    sums = Window.partitionBy(shard).orderBy(part)
    firsts = materialise(placed.groupBy(shard, part).count().select(shard, part, (F.sum("count").over(sums) - F.col("count")).alias(first)))
    again = Window.partitionBy(shard, part).orderBy(F.xxhash64(uid, F.lit(seed + 2)), uid)
    placed = placed.withColumn(rank, F.row_number().over(again) - 1).join(small_or_not(firsts), [shard, part])
    return placed.select(*df.columns, shard, (F.col(first) + F.col(rank)).alias(slot))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null: this law has none)."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
