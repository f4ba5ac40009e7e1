"""Reading documents, separating what cannot be analysed, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.plans.policy import DEFAULT, Policy


def read(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", fmt: str = "parquet") -> DataFrame:
    """(doc_id, text) of a table in any format that Spark reads; only these columns are scanned."""
    return spark.read.format(fmt).load(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: a file of one row group is read by one task.  Tables over ``SMALL_BYTES`` stay as they are."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL_BYTES:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def status(policy: Policy = DEFAULT) -> F.Column:
    """The answer's status: 400 for no text, 413 for too much, 200 else."""
    n = F.length("text")
    return F.when(n.isNull() | (n == 0), 400).when(n > policy.max_text, 413).otherwise(200)


def valid(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return docs.where(status(policy) == 200)


def rejects(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(doc_id, status) of what is not analysed."""
    return docs.withColumn("status", status(policy)).where("status <> 200").select("doc_id", "status")


def as_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One JSON answer per document: {"suggestions": [...]} in the rows' order."""
    fields = [c for c in rows.columns if c != key]
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(["ord"] if "ord" in fields else []), *[c for c in fields if c != "ord"]))).alias("suggestions"))
    return listed.select(key, F.to_json(F.struct("suggestions")).alias("body"))


def write(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    rows.write.format(fmt).mode(mode).save(path)
