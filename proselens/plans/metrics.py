"""Metrics of a run: counts that are taken while the rows pass, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from proselens.plans.policy import CATEGORIES, SEVERITIES


def counted(rows: DataFrame, name: str = "suggestions") -> tuple[DataFrame, Observation]:
    """Suggestion rows as they are, and an observation whose ``get`` has their numbers once the rows have been written.

    Streams report the same numbers to their query listeners, under the observation's name.
    """
    seen = Observation(name)
    by_category = [F.count_if(F.col("category") == c).alias(f"category_{c}") for c in CATEGORIES]
    by_severity = [F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *by_category, *by_severity), seen


def clipped(text: str | None, most: int = 160) -> str:
    """A text short enough for a log line."""
    text = text or ""
    return text if len(text) <= most else f"{text[:most]}…"
