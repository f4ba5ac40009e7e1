"""Range algebra: half-open [start, end) ranges, as arrays within a row or as tables keyed by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = "struct<start:int,end:int>"


def merge_array(ranges: Column) -> Column:
    """Ranges of an array merged where they overlap or touch."""
    none = F.array().cast(f"array<{RANGE}>")

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        apart = (F.size(done) == 0) | (r["start"] > F.try_element_at(done, F.lit(-1))["end"])
        return F.when(apart, F.array_append(done, r)).otherwise(F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined))

    clean = F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end")))
    return F.aggregate(F.array_sort(clean), none, step)


def merge_table(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same over a table (key, start, end): a new island begins where a start is past every end before it."""
    order = W.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def within(start: Column, end: Column, ranges: Column) -> Column:
    """Whether one of the ranges holds [start, end)."""
    return F.exists(ranges, lambda r: (start >= r["start"]) & (end <= r["end"]))


def intersects(start: Column, end: Column, ranges: Column) -> Column:
    """Whether one of the ranges overlaps [start, end); an empty range at a boundary does not."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))


def _residual(left: DataFrame, right: DataFrame, key: str, condition, how: str) -> DataFrame:
    other = right.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return left.join(other, (F.col(key) == F.col("_k")) & condition, how)


def within_join(rows: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows inside one of their document's allowed ranges (semi-join: equal keys, then the interval condition)."""
    return _residual(rows, allowed, key, (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left_semi")


def outside_join(rows: DataFrame, forbidden: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that touch none of their document's forbidden ranges (anti-join)."""
    return _residual(rows, forbidden, key, (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_anti")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def ordered(start: Column, end: Column) -> Column:
    """A reversed range turned round."""
    return F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"))


def shift(rows: DataFrame, by: Column | int) -> DataFrame:
    return rows.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def change_span(a: Column, b: Column) -> Column:
    """What differs between two texts: struct<start, end_a, end_b>, null if nothing.

    The common prefix is found by halving (twenty comparisons decide a million characters), and so is the suffix.
    """
    least = F.least(F.length(a), F.length(b))

    def common(limit: Column, same) -> Column:
        start = F.struct(F.lit(0).alias("low"), limit.cast("int").alias("high"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.ceil((s["low"] + s["high"]) / 2).cast("int")
            hit = same(mid)
            return F.struct(F.when(hit, mid).otherwise(s["low"]).alias("low"), F.when(hit, s["high"]).otherwise(F.greatest(mid - 1, s["low"])).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(22)), start, halve, lambda s: s["low"])

    prefix = common(least, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))

    def rest(p: Column) -> Column:
        suffix = common(least - p, lambda n: F.when(n == 0, F.lit(True)).otherwise(F.right(a, n) == F.right(b, n)))
        return F.struct(p.alias("start"), (F.length(a) - suffix).alias("end_a"), (F.length(b) - suffix).alias("end_b"))

    return F.when(a != b, F.element_at(F.transform(F.array(prefix), rest), 1))


def shift_after_edit(rows: DataFrame, edit_start: Column, end_old: Column, end_new: Column) -> DataFrame:
    """Open rows from the edit on move by its growth; then all rows that overlap the new text go."""
    by = F.when(~F.coalesce("applied", F.lit(False)) & (F.col("start") >= edit_start), end_new - end_old).otherwise(0)
    moved = rows.withColumn("_by", by)
    moved = moved.withColumns({"start": F.col("start") + F.col("_by"), "end": F.col("end") + F.col("_by")}).drop("_by")
    return moved.where(~((F.col("start") < end_new) & (F.col("end") > edit_start)))
