"""Shared helpers: reliable checkpoints, size-checked broadcasts and text constants."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import brief_shuffles  # noqa: F401

#: White space as the contracts of this subpackage define it: space, tab, LF, VT, FF, CR.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest number of narrow rows (a few longs each, some 50 MB in all) that is broadcast.
BROADCAST_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; choose one only where none is set and the
    executors share this machine (tests). On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: its rows are then
    fixed, its lineage is cut, and they outlive the executors that made them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: like materialise, for wide rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def collected(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans, broadcasts and shuffles of steps that are over. The
    driver's memory otherwise grows up to its bound in a job of many steps, whatever they need."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for a broadcast if it has at most `rows` rows, else leave it to a shuffled join.

    df must be materialised and narrow: it is counted up to the bound and used again.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key that a join meets in one part; keys with more are split.
HUB = 256


def hubs(rows: DataFrame, key: str) -> DataFrame | None:
    """key, fan: the values of a key that more than HUB rows have, and into how many parts to
    split them; None if there is none. There are at most a HUB-th as many as rows, so they are
    mostly broadcast."""
    heavy = rows.groupBy(key).agg(F.count("*").alias("held")).where(F.col("held") > HUB)
    heavy = materialise(heavy.select(key, F.ceil(F.col("held") / HUB).cast("int").alias("fan")))
    count = heavy.limit(BROADCAST_ROWS + 1).count()
    return None if count == 0 else F.broadcast(heavy) if count <= BROADCAST_ROWS else heavy


def join_split(rows: DataFrame, table: DataFrame, key: str, by: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined to table, which has a row for each value of key at most. A value in `heavy`
    (of hubs) is met in parts: its rows are dealt by the column `by`, its table row is repeated."""
    if heavy is None:  # each broadcast of no rows would still take threads and memory of the driver
        return rows.join(table, key, how)
    fan = F.coalesce("fan", F.lit(1))
    dealt = rows.join(heavy, key, "left").withColumn("part", F.pmod(F.xxhash64(by), fan).cast("int")).drop("fan")
    repeated = table.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), fan - 1))).drop("fan")
    return dealt.join(repeated, [key, "part"], how).drop("part")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
