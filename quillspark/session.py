"""A session with the settings that the operators expect."""

from __future__ import annotations

import re
import tempfile

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans and skew joins; sizes of shuffles are left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python, so that pages of any size fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; only a local session may go without a folder for it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may go without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would use for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def storage(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified path, as tasks see it, and the path in it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path)
