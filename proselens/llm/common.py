"""Shared helpers of the training-data operators: tables, and cutting lineage through written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches: whole texts are long, and a batch stands in memory several times on its way to Python.

    Only where the session has no sizes of its own: a plan reads them when it is run, which is after this returns.
    """
    for name, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "4m")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (driver and executor are one machine) gets a temporary one; on a cluster that is
    an error, as each machine would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="proselens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends there, and a lost executor costs nothing.

    The folder goes when the JVM ends; a caller that knows that the table is no longer needed calls ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what this one write has shuffled is of no use after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what ``cut`` has written for this DataFrame."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the DataFrame does not have, made from those given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A written table as a broadcast side if its rows, of at most that many bytes, stay under the limit; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
