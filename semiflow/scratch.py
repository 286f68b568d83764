"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode, where it is unset, a folder of our own; a cluster must name one that all executors see."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="semiflow-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder."""
    at = scratch(spark, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return at


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def forget(*dfs: DataFrame | None) -> None:
    """Deletes the tables that cut() wrote for these; nothing that was made from them may be read any more, unless it was cut itself."""
    for df in dfs:
        at = getattr(df, "_cut_at", None) if df is not None else None
        if at:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
