"""Work on changes only: equal texts once, requests by size of the edit, the latest version of a document, debouncing."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.operators.ranges import change_span
from proselens.plans.policy import DEFAULT, Policy


def text_key(text: Column, base: Column | int = 0, version: str = "1") -> Column:
    """The key of a text's result: text, where it begins, and the version of the rules."""
    return F.sha2(F.concat_ws("|", F.lit(version), F.lit(base).cast("string") if isinstance(base, int) else base.cast("string"), text), 256)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text_hash, text, doc_id): each text once, with the smallest of its document ids."""
    hashed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))


def for_all_copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of distinct texts (by text_hash) for every document of that text."""
    keys = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return keys.join(rows.drop("doc_id"), "text_hash").drop("text_hash")


def routed(pairs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(doc_id, old, new) with the span that differs and ``route``: none, scoped (a small edit) or full."""
    span = F.when(F.col("old").isNotNull() & (F.col("old") != ""), change_span(F.col("old"), F.col("new")))
    found = pairs.withColumn("span", span)
    small = F.col("span.end_b") - F.col("span.start") <= policy.small_edit
    blank = F.trim(F.coalesce("new", F.lit(""))) == ""
    return found.withColumn("route", F.when(blank, "none").when(F.col("span").isNotNull() & small, "scoped").otherwise("full"))


def latest(versions: DataFrame, key: str = "doc_id", order: str = "version") -> DataFrame:
    """The last version of each document's text."""
    return versions.groupBy(key).agg(F.max_by("text", order).alias("text"), F.max(order).alias(order))


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Bursts of events without a pause of ``gap``: key, start, end (of the last event) and the number of events."""
    found = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return found.select(key, "start", "end", "n")


def scoped(text: Column, start: Column, end: Column) -> Column:
    """The part of a text a request is about: struct<base, part>; an odd or full scope is the whole text from 0."""
    low = F.greatest(F.lit(0), F.least(start, F.length(text)))
    high = F.greatest(F.lit(0), F.least(end, F.length(text)))
    real = (high - low > 0) & (high - low < F.length(text))
    return F.struct(F.when(real, low).otherwise(0).alias("base"), F.when(real, F.substring(text, low + 1, high - low)).otherwise(text).alias("part"))


def current(results: DataFrame, versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results (key, version, ...) that are about the latest version of their document; others came too late."""
    newest = versions.groupBy(key).agg(F.max("version").alias("version"))
    return results.join(newest, [key, "version"], "left_semi")


def cached(requests: DataFrame, cap: int = 200, seconds: float = 120.0, by: str = "node") -> DataFrame:
    """Requests (node, seq, at, text_key) with ``hit``: whether the node's cache of results answers them.

    A result is kept for ``seconds`` from when it was put in, whether it is used or not; at ``cap`` results the one used
    longest ago goes.  Each node has a cache of its own, and its requests are gone through in order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[str, float] = OrderedDict()
        rows, hits = rows.sort_values(["at", "seq"]), []
        for key, at in zip(rows["text_key"], rows["at"], strict=True):
            hit = key in held and at - held[key] <= seconds
            hits.append(hit)
            if hit:
                held.move_to_end(key)
                continue
            held.pop(key, None)
            while len(held) >= cap:
                held.popitem(last=False)
            held[key] = at
        return rows.assign(hit=hits)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.groupBy(by).applyInPandas(run, f"{kinds}, hit boolean")
