"""Session defaults and the checkpoint that iterative operators cut their lineage with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "planimetra", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; conf overrides."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read back: rows fixed, lineage gone.
    Where none is set, a local session gets a temporary folder; on a cluster that is an error."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, by a Parquet table there whose size is known. A checkpoint keeps the estimate of its
    plan; where each round joins the last with itself that has twice as many digits every time,
    and takes minutes to work out after some fifteen rounds."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes a table as of stored that nothing reads any more; any other is left alone."""
    files = df.inputFiles()
    if not files:
        return
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    system = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    # qualified, as one folder may be written file:/x and file:///x
    shared = system.makeQualified(sc._jvm.org.apache.hadoop.fs.Path(_folder(df)))
    if system.makeQualified(folder.getParent()).equals(shared):
        system.delete(folder, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Of the frames made within, shuffle files are removed as soon as the action that wrote them
    ends. Otherwise they stay until the driver collects garbage, so that a job of many steps holds
    those of several. Such a frame is for one action: another one computes its shuffles anew."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()
