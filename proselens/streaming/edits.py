"""A stream of edits (doc_id, ts, version, text) to the suggestions of settled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.operators.gate import as_rows, final_local


def settled(edits: DataFrame, pause: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last text of each burst of edits of a document; a burst ends with a pause.  Late edits are dropped after ``late``."""
    bursts = edits.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", pause).alias("w"))
    found = bursts.agg(F.max_by("text", F.struct("ts", "version")).alias("text"), F.max("version").alias("version"), F.count("*").alias("edits"))
    return found.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "version", "edits", "text")


def once(settled_texts: DataFrame, keep: str = "2 minutes") -> DataFrame:
    """Texts not analysed before: state for a text is kept for ``keep`` of event time, like a cache's time to live."""
    marked = settled_texts.withColumn("text_hash", F.sha2("text", 256)).withWatermark("end", keep)
    return marked.dropDuplicatesWithinWatermark(["doc_id", "text_hash"])


def suggestions(texts: DataFrame) -> DataFrame:
    """What the rules report on each settled text."""
    return as_rows(texts, final_local(F.coalesce("text", F.lit(""))))
