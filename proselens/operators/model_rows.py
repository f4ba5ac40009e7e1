"""Rows of an external model: reading its JSON, checking every field, finding the originals, and a last check of sanity.

Input is a table (doc_id, chunk_id, chunk_start, prefix_len, raw); the model itself is behind a hook and not needed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proselens.functions.text import checksum, has_letter, slice_of
from proselens.operators.alignment import align
from proselens.operators.ranges import clamp, intersects, within
from proselens.plans.policy import CATEGORIES, DEFAULT, DIFF_KINDS, SEVERITIES, Policy


class Refused(Exception):
    """What a client raises when the model's service answers with a status of its own."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message)
        self.status = status


def mapped(error: Exception) -> int:
    """The status that a failed request gets: the service's own for a bad key or too many requests, else 502."""
    status = getattr(error, "status", None)
    return status if status in (400, 401, 403, 408, 413, 429) else 502


def call(chunks: DataFrame, client: Callable[[str], str], at_once: int = 4, per_second: float | None = None) -> DataFrame:
    """Adds ``raw``, a client's answer to each row's ``prompt``; an error is an empty answer, its text is in ``error`` and its
    number in ``status`` (200: none).

    A task has ``at_once`` requests under way, and begins at most ``per_second`` of them.
    """
    names = chunks.columns

    def ask(prompt: str) -> tuple[str | None, str | None, int]:
        try:
            return client(prompt), None, 200
        except Exception as e:  # noqa: BLE001  one row's failure must not end the corpus
            return None, str(e), mapped(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = time.monotonic()
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                under_way = []
                for prompt in batch.column("prompt").to_pylist():
                    if per_second:
                        time.sleep(max(0.0, due - time.monotonic()))
                        due = max(due, time.monotonic()) + 1 / per_second
                    under_way.append(pool.submit(ask, prompt))
                found = [f.result() for f in under_way]
                extra = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.record_batch([*batch.columns, *extra], [*names, "raw", "error", "status"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(work, f"{schema}, raw string, error string, status int")


def unfenced(raw: Column) -> Column:
    """JSON text without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), "(?i)\\A```(?:json)?", ""), "```\\z", "")


def parsed(raw: DataFrame) -> DataFrame:
    """One row per suggestion in the answers, as variant ``v``, with its number; answers that are no such JSON have none."""
    whole = F.try_parse_json(unfenced(F.col("raw")))
    listed = F.try_variant_get(whole, "$.suggestions", "array<variant>")
    return raw.withColumn("_list", listed).select(*[c for c in raw.columns if c != "raw"], F.posexplode("_list").alias("item", "v"))


def _is(kind: str, path: str) -> Column:
    shape = F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant"))
    return F.coalesce(shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"), F.lit(False)) if kind == "number" else F.coalesce(shape == "STRING", F.lit(False))


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("v"), path, "string")


def _number(path: str) -> Column:
    return F.when(_is("number", path), F.try_variant_get(F.col("v"), path, "double"))


def validated(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """Checked rows (doc_id, chunk_id, item, fields) in the coordinates of the document's text.

    Rows without numeric ranges go; ranges are moved from the chunk to the text and cut to it; unknown categories are
    ``other``, unknown severities ``info``, unknown kinds and confidences outside of 0 to 1 null.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = parsed(raw).where(_is("number", "$.range.start") & _is("number", "$.range.end")).join(text, "doc_id")

    def place(path: str) -> Column:
        return clamp(_number(path).cast("int") - F.col("prefix_len") + F.col("chunk_start"), F.lit(0), F.length("text"))

    def one_of(path: str, known: tuple[str, ...], other: str | None) -> Column:
        return F.when(_text(path).isin(*known), _text(path)).otherwise(other)

    given = F.when(_is("string", "$.original"), _text("$.original"))
    rows = rows.withColumns({"start": place("$.range.start"), "end": place("$.range.end"), "given": given})
    confidence = _number("$.confidence")
    return rows.select(
        "doc_id", "chunk_id", "item", "start", "end", "given",
        F.coalesce(_text("$.title"), F.lit("Suggestion")).alias("title"),
        F.nullif(_text("$.message"), F.lit("")).alias("message"),
        one_of("$.category", CATEGORIES, "other").alias("category"),
        one_of("$.severity", SEVERITIES, "info").alias("severity"),
        F.coalesce("given", slice_of(F.col("text"), F.col("start"), F.col("end"))).alias("original"),
        F.coalesce(_text("$.replacement"), F.lit("")).alias("replacement"),
        F.when(_is("string", "$.before"), _text("$.before")).alias("before"),
        F.when(_is("string", "$.after"), _text("$.after")).alias("after"),
        F.when(confidence.between(0, 1), confidence).alias("confidence"),
        F.when(_is("string", "$.diffKind"), one_of("$.diffKind", DIFF_KINDS, None)).alias("diff_kind"),
        _number("$.changedTokens").cast("int").alias("changed_tokens"),
        F.when(_is("string", "$.justification"), _text("$.justification")).alias("justification"),
        checksum(F.coalesce(F.nullif("given", F.lit("")), slice_of(F.col("text"), F.col("start"), F.col("end")))).alias("checksum"),
        "prefix_len", "text",
    )


def sane(policy: Policy = DEFAULT) -> Column:
    """Whether an edit is plausible: in bounds, not too long, no question mark within a word, no letters for spacing."""
    left = F.when(F.col("start") > 0, F.substring("text", F.col("start"), F.lit(1))).otherwise("")
    right = F.substring("text", F.col("end") + 1, F.lit(1))
    asks = F.contains("replacement", F.lit("?")) & ~F.contains(F.coalesce("original", F.lit("")), F.lit("?")) & (F.col("category") != "punctuation") & has_letter(left) & has_letter(right)
    letters = (F.col("category") == "spacing") & has_letter(F.col("replacement"))
    return (F.col("end") >= F.col("start")) & (F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.length("replacement") <= policy.max_replacement) & ~asks & ~letters


def judged(raw: DataFrame, docs: DataFrame, prose: Column | None = None, forbidden: Column | None = None, policy: Policy = DEFAULT, mode: str = "intended") -> DataFrame:
    """Validated rows, moved to where their original stands, and ``stage``: the last step that each has passed.

    Steps: range (1), after the prefix (2), outside of forbidden ranges and inside prose (3), its original stands in the
    text (4), sane (5).  ``mode="observed"``: the original that is looked for is that of the answer's item whose number is
    the row's place among those that are left, as the analysed service has it.
    """
    rows = validated(raw, docs)
    here, yes = F.struct(F.col("start").alias("start"), F.col("end").alias("end")), F.lit(True)
    placed = (~intersects(F.col("start"), F.col("end"), forbidden) if forbidden is not None else yes) & (within(F.col("start"), F.col("end"), prose) if prose is not None else yes)
    rows = rows.withColumn("_open", (F.col("start") >= F.col("prefix_len"))).withColumn("_placed", F.col("_open") & placed)
    if mode == "observed":
        place = F.row_number().over(W.partitionBy("doc_id", "chunk_id", "_placed").orderBy("item")) - 1
        others = parsed(raw).select("doc_id", "chunk_id", F.col("item").alias("_at_item"), F.when(_is("string", "$.original"), _text("$.original")).alias("_theirs"))
        rows = rows.withColumn("_at_item", place).join(others, ["doc_id", "chunk_id", "_at_item"], "left").withColumn("given", F.when(F.col("_placed"), F.col("_theirs")).otherwise(F.col("given"))).drop("_at_item", "_theirs")
    found = align(F.col("text"), F.col("start"), F.col("end"), F.col("given"), F.col("replacement"), F.col("before"), F.col("after"))
    known = F.coalesce(F.length("given") > 0, F.lit(False))
    rows = rows.withColumn("_at", F.when(F.col("_placed"), F.when(known, found).otherwise(here)))
    rows = rows.withColumn("_found", F.col("_at").isNotNull()).withColumns({"start": F.coalesce("_at.start", "start"), "end": F.coalesce("_at.end", "end")})
    passed = F.when(~F.col("_open"), 1).when(~F.col("_placed"), 2).when(~F.col("_found"), 3).when(~F.coalesce(sane(policy), F.lit(False)), 4).otherwise(5)
    return rows.withColumn("stage", passed).drop("_at", "_open", "_placed", "_found", "text", "given", "prefix_len")


def accepted(raw: DataFrame, docs: DataFrame, prose: Column | None = None, forbidden: Column | None = None, policy: Policy = DEFAULT, mode: str = "intended") -> DataFrame:
    """Validated rows that are outside of forbidden ranges and inside prose, moved to where their original stands, and sane."""
    return judged(raw, docs, prose, forbidden, policy, mode).where("stage = 5").drop("stage")


STAGES = ["with_range", "after_prefix", "in_place", "found", "kept"]


def stages(raw: DataFrame, docs: DataFrame, prose: Column | None = None, forbidden: Column | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """How many rows each step leaves: (stage, n), from the items of the answers on."""
    items = parsed(raw).agg(F.count("*").alias("n")).select(F.lit("parsed").alias("stage"), "n")
    left = judged(raw, docs, prose, forbidden, policy).agg(*(F.count_if(F.col("stage") > i).alias(name) for i, name in enumerate(STAGES)))
    return items.unionByName(left.select(F.explode(F.array(*(F.struct(F.lit(name).alias("stage"), F.col(name).alias("n")) for name in STAGES))).alias("x")).select("x.*"))
