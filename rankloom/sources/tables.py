"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is not set, a folder of this machine, but only if all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``clear`` deletes it."""
    return f"{shared_dir(spark).rstrip('/')}/rankloom-{spark.sparkContext.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written.  Frames read from them can't be used afterwards."""
    drop_path(spark, own_dir(spark))


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read back: lineage ends there, and what was not deterministic is settled."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, what: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that this application makes once: later calls with the same ``what`` read what the first has written."""
    key = (spark.sparkContext.applicationId, own_dir(spark), *what)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_kept.get(key, own_dir(spark))}/_SUCCESS")
    if key not in _kept or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        path = f"{own_dir(spark)}/kept-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])
