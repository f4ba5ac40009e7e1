"""From all suggestions of a document to those that are shown: ordered selection, then the gate for style.

The selection is a fold in a fixed order (local rows first, then by start), as what is kept decides on what follows;
it runs inside the row, over the document's own suggestions, so a corpus needs no shuffle for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions.text import has_letter, let, letter_count, normalized, token_count, token_distance
from proselens.operators.rules import local_rows
from proselens.operators.structure import paragraph_of, paragraphs
from proselens.plans.policy import DEFAULT, Policy

FIELDS = [
    ("source", "string"), ("start", "int"), ("ord", "int"), ("end", "int"), ("rule", "int"), ("title", "string"), ("message", "string"), ("category", "string"), ("severity", "string"),
    ("original", "string"), ("replacement", "string"), ("before", "string"), ("after", "string"), ("confidence", "double"), ("diff_kind", "string"), ("changed_tokens", "int"), ("justification", "string"),
]
ROW = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS) + ">"
ROWS = f"array<{ROW}>"


def full_rows(rows: Column, source: str = "local") -> Column:
    """Rows of the rules with the fields that only a model fills."""

    def full(r: Column, i: Column) -> Column:
        own = {"source": F.lit(source), "ord": i}
        given = ("start", "end", "rule", "title", "message", "category", "severity", "original", "replacement")
        return F.struct(*(own.get(n, r[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in FIELDS))

    return F.transform(rows, full)


def _key(r: Column) -> Column:
    return F.concat_ws("|", normalized(r["original"]), normalized(r["replacement"]), r["title"])


def select(rows: Column, text: Column, policy: Policy = DEFAULT) -> Column:
    """The fold: overlap with what is kept, near repetition of it, and quotas; kept rows in the order of the fold."""

    def turned(r: Column) -> Column:
        swap = {"start": F.least(r["start"], r["end"]), "end": F.greatest(r["start"], r["end"])}
        return F.struct(*(swap.get(n, r[n]).alias(n) for n, _ in FIELDS))

    def admitted(r: Column) -> Column:
        sure = F.when(r["category"] == "other", policy.min_confidence_other).otherwise(policy.min_confidence)
        ok = (r["start"] >= 0) & (r["end"] <= F.length(text)) & (F.coalesce(r["confidence"], F.lit(1.0)) >= sure)
        ok &= ~((r["category"] == "spacing") & has_letter(r["replacement"]))
        if not policy.enable_style:
            ok &= r["category"] != "style"
        if not policy.enable_other:
            ok &= r["category"] != "other"
        return ok

    def keyed(r: Column) -> Column:
        return F.struct(F.when(r["source"] == "local", 0).otherwise(1).alias("late"), r["start"].alias("start"), r["ord"].alias("ord"), _key(r).alias("k"), r.alias("r"))

    ordered = F.array_sort(F.transform(F.filter(F.transform(rows, turned), admitted), keyed))
    quotas = {"style": policy.style_quota, "other": policy.other_quota}
    none = F.array().cast("array<struct<start:int,end:int,k:string>>")

    def short(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["r"]["end"].alias("end"), x["k"].alias("k"))

    def fold(rows: Column) -> Column:
        # the state holds numbers of kept rows, not the rows
        def step(a: Column, n: Column) -> Column:
            x = n["x"]

            def judged(reach: Column) -> Column:
                clash = F.exists(reach, lambda o: ((x["start"] < o["end"]) & (x["r"]["end"] > o["start"])) | ((F.abs(o["start"] - x["start"]) <= policy.near_distance) & (o["k"] == x["k"])))
                return let(~clash, lambda clear: added(reach, clear))

            def added(reach: Column, clear: Column) -> Column:
                full = F.lit(False)
                for name, most in quotas.items():
                    full |= (x["r"]["category"] == name) & (a[name] >= most)
                counts = [(a[name] + F.when(clear & (x["r"]["category"] == name), 1).otherwise(0)).alias(name) for name in quotas]
                keep = clear & ~full
                return F.struct(F.when(keep, F.array_append(a["kept"], n["i"])).otherwise(a["kept"]).alias("kept"), F.when(keep, F.array_append(reach, short(x))).otherwise(reach).alias("near"), *counts)

            # rows of one source come by start: only kept rows that reach to here can clash with them; a later source meets all
            reach = F.filter(a["near"], lambda o: (o["end"] > x["start"]) | (o["start"] >= x["start"] - policy.near_distance))
            everything = F.transform(a["kept"], lambda i: short(F.get(rows, i)))
            return let(F.when(x["late"] == 0, reach).otherwise(everything), judged)

        start = F.struct(F.array().cast("array<int>").alias("kept"), none.alias("near"), *(F.lit(0).alias(name) for name in quotas))
        numbered = F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.aggregate(numbered, start, step, lambda a: F.transform(a["kept"], lambda i: F.get(rows, i)["r"]))

    return let(ordered, fold)


def style_budget(length: Column, correctness: Column, policy: Policy = DEFAULT) -> Column:
    """How many style rows a text may have: for each begun thousand of code points, by the number of corrections."""
    base = F.least(F.lit(policy.style_per_1k), F.floor(policy.style_ratio * correctness)).cast("int")
    return (F.when(base > 0, base).otherwise(policy.style_per_1k) * F.ceil(length / 1000)).cast("int")


def style_verdict(r: Column, text: Column, total_tokens: Column, policy: Policy = DEFAULT) -> Column:
    """struct<reason, changed>: why a style row is too much (null: it is not), and how many tokens it changes."""
    original, replacement = F.coalesce(r["original"], F.substring(text, r["start"] + 1, r["end"] - r["start"])), F.coalesce(r["replacement"], F.lit(""))
    allowed = F.coalesce(r["diff_kind"].isin(*policy.allowed_kinds), F.lit(False))
    left = F.when(r["start"] > 0, F.substring(text, r["start"], F.lit(1))).otherwise("")
    right = F.substring(text, r["end"] + 1, F.lit(1))
    boundary = replacement.rlike("[.,!?:;]") & has_letter(left) & has_letter(right)

    def judged(changed: Column) -> Column:
        ratio = changed / F.greatest(total_tokens, F.lit(1))
        reason = F.when(boundary, "boundary").when(~allowed & (letter_count(replacement) > letter_count(original)), "adds_letters").when(~allowed & (ratio > policy.max_change_ratio), "too_much")
        return F.struct(reason.alias("reason"), changed.cast("int").alias("changed"))

    return let(token_distance(original, replacement), judged)


def gate(kept: Column, text: Column, policy: Policy = DEFAULT, mode: str = "observed") -> Column:
    """Kept rows after the style gate, by start (others before style at the same place).

    Style rows need their confidence, a small change, room in their paragraph (one, where anything else is reported
    there) and room in the text's budget; a row turned away by its paragraph uses none of the budget.
    """

    def gated(x: Column) -> Column:
        others, busy = x["others"], x["busy"]

        def fit(r: Column) -> Column:
            return (r["category"] == "style") & (F.coalesce(r["confidence"], F.lit(1.0)) >= policy.min_confidence_style)

        def with_change(r: Column) -> Column:
            verdict = style_verdict(r, text, x["tokens"], policy)
            return F.struct(verdict.alias("v"), r.alias("r"), paragraph_of(r["start"], r["end"], x["paragraphs"]).alias("p"))

        small = F.filter(F.transform(F.filter(x["kept"], fit), with_change), lambda c: c["v"]["reason"].isNull())
        state = F.struct(F.array().cast(ROWS).alias("rows"), F.array().cast("array<int>").alias("done"))

        def step(a: Column, c: Column) -> Column:
            crowded = F.array_contains(busy, c["p"]) & (F.size(F.filter(a["done"], lambda d: d == c["p"])) >= policy.paragraph_cap)
            row = F.struct(*((c["v"]["changed"] if n == "changed_tokens" else c["r"][n]).alias(n) for n, _ in FIELDS))
            drop = crowded | (F.size(a["rows"]) >= x["budget"])
            return F.struct(F.when(drop, a["rows"]).otherwise(F.array_append(a["rows"], row)).alias("rows"), F.when(drop, a["done"]).otherwise(F.array_append(a["done"], c["p"])).alias("done"))

        style = F.aggregate(small, state, step, lambda a: a["rows"])
        numbered = F.transform(F.concat(others, style), lambda r, i: F.struct(r["start"].alias("start"), i.alias("i"), r.alias("r")))
        return F.transform(F.array_sort(numbered), lambda n: n["r"])

    def counted(x: Column) -> Column:
        correct = F.size(F.filter(x["others"], lambda r: r["category"].isin("spacing", "punctuation", "spelling")))
        busy = F.array_distinct(F.transform(x["others"], lambda r: paragraph_of(r["start"], r["end"], x["paragraphs"])))
        return F.struct(x["kept"].alias("kept"), x["others"].alias("others"), x["paragraphs"].alias("paragraphs"), x["tokens"].alias("tokens"), busy.alias("busy"), style_budget(F.length(text), correct, policy).alias("budget"))

    def parted(k: Column) -> Column:
        return F.struct(k.alias("kept"), F.filter(k, lambda r: r["category"] != "style").alias("others"), paragraphs(text, mode).alias("paragraphs"), token_count(text).alias("tokens"))

    return let(kept, lambda k: let(parted(k), lambda x: let(counted(x), gated)))


def final_rows(rows: Column, text: Column, policy: Policy = DEFAULT, mode: str = "observed") -> Column:
    """Selection and gate over all suggestions of a text."""
    return gate(select(rows, text, policy), text, policy, mode)


def final_local(text: Column, policy: Policy = DEFAULT, mode: str = "observed") -> Column:
    """What the rules alone report on a text that is prose throughout."""
    return final_rows(full_rows(local_rows(text)), text, policy, mode)


def as_rows(docs: DataFrame, rows: Column, key: str = "doc_id") -> DataFrame:
    """One row per suggestion, with its id, checksum and number."""
    found = docs.select(key, F.posexplode(rows).alias("n", "s"))
    fields = [F.col(f"s.{n}").alias(n) for n, _ in FIELDS if n != "ord"]
    return found.select(
        key,
        F.sha2(F.concat_ws("|", key, "s.start", "s.end", "s.title", "s.replacement"), 256).alias("suggestion_id"),
        F.col("n").alias("ord"), *fields,
        F.when(F.length("s.original") > 0, F.sha2("s.original", 256)).alias("checksum"),
    )
