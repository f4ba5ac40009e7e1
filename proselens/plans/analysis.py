"""The whole analysis of a corpus: valid documents, structure, rules, model rows, selection and gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.functions.markdown import masked, with_structure
from proselens.operators.gate import FIELDS, ROWS, as_rows, final_rows, full_rows
from proselens.operators.model_rows import accepted
from proselens.operators.rules import local_rows
from proselens.plans.policy import DEFAULT, Policy
from proselens.sources.documents import valid


def analyse(docs: DataFrame, raw: DataFrame | None = None, policy: Policy = DEFAULT, mode: str = "observed") -> DataFrame:
    """Suggestion rows of ``docs`` (doc_id, text); ``raw``: a model's answers (see ``operators.model_rows``), if any.

    Without model rows the plan has no shuffle: each document is worked on where it is read.
    """
    read = with_structure(valid(docs.select("doc_id", "text"), policy))
    local = full_rows(masked(local_rows(F.col("text")), F.col("prose"), F.col("forbidden")))
    if raw is None:
        return as_rows(read, final_rows(local, F.col("text"), policy, mode))
    rows = accepted(raw, read, policy=policy).join(read.select("doc_id", "prose", "forbidden"), "doc_id")
    rows = rows.where(F.exists("prose", lambda r: (F.col("start") >= r["start"]) & (F.col("end") <= r["end"])) & ~F.exists("forbidden", lambda r: (F.col("start") < r["end"]) & (F.col("end") > r["start"])))
    known = {"source": F.lit("ai"), "ord": F.col("chunk_id") * 1_000_000 + F.col("item"), "rule": F.lit(0)}
    packed = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*(known.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in FIELDS))).alias("model"))
    joined = read.join(packed, "doc_id", "left")
    every = F.concat(local, F.coalesce(F.col("model"), F.array().cast(ROWS)))
    return as_rows(joined, final_rows(every, F.col("text"), policy, mode))
