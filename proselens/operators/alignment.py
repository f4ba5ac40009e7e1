"""Finding again where a text stands: exact occurrences near an expected place, chosen by anchors and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselens.functions.text import SPACE, let, running, slice_of
from proselens.operators.ranges import RANGE
from proselens.operators.structure import is_sentence_start


def occurrences(text: Column, wanted: Column) -> Column:
    """The starts of all occurrences, overlapping ones too.

    The text is split before each of them, so a long text costs its length and the list no more than the places in it.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(wanted, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.transform(F.split(text, quoted, -1), lambda p: F.length(p))
    first = F.when(F.startswith(text, wanted), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.concat(first, let(running(pieces), lambda r: F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))))


def case_only(original: Column, replacement: Column) -> Column:
    return (F.length(original) == F.length(replacement)) & (F.lower(original) == F.lower(replacement)) & (original != replacement)


def anchored(text: Column, at: Column, length: Column, before: Column, after: Column) -> Column:
    """Whether ``before`` stands right before a place and ``after`` right after it; missing anchors are met."""
    left = F.length(before) == 0
    right = F.length(after) == 0
    ok_left = left | (slice_of(text, F.greatest(at - F.length(before), F.lit(0)), at) == before)
    ok_right = right | (F.substring(text, at + length + 1, F.length(after)) == after)
    return F.coalesce(ok_left, F.lit(True)) & F.coalesce(ok_right, F.lit(True))


def align(text: Column, start: Column, end: Column, original: Column, replacement: Column, before: Column, after: Column) -> Column:
    """The range that an original stands at: the given one if it does, else the nearest occurrence, else null.

    Occurrences between their anchors go before others; for a change of case only, the start of a sentence counts 50
    places nearer; the first of equals is taken.
    """
    n = F.length(original)

    def nearest(all_: Column) -> Column:
        good = F.filter(all_, lambda p: anchored(text, p, n, before, after))
        usable = F.when(F.size(good) > 0, good).otherwise(all_)
        bonus = case_only(original, F.coalesce(replacement, F.lit("")))
        scored = F.transform(usable, lambda p: F.struct((F.abs(p - start) - F.when(bonus & is_sentence_start(text, p), 50).otherwise(0)).alias("score"), p.alias("p")))
        return let(F.array_min(scored), lambda m: F.when(m.isNotNull(), F.struct(m["p"].cast("int").alias("start"), (m["p"] + n).cast("int").alias("end"))))

    there = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    found = F.when(slice_of(text, start, end) == original, there).otherwise(let(occurrences(text, original), nearest))
    return F.when(n > 0, found).otherwise(F.lit(None).cast(RANGE))


def relocate(text: Column, start: Column, end: Column, original: Column, replacement: Column, before: Column, after: Column) -> Column:
    """Where to apply a suggestion if its range no longer holds its original: aligned, or nearby but for white space; else null."""
    n = F.length(original)
    window = F.when(F.coalesce(n, F.lit(0)) <= 2, 80).otherwise(300)
    low, high = F.greatest(start - window, F.lit(0)), F.least(start + window, F.length(text))
    wanted = normalized_case(original)

    def fuzzy(places: Column) -> Column:
        ok = F.filter(places, lambda p: F.startswith(normalized_case(slice_of(text, p, F.least(high, p + n + 40))), wanted) & anchored(text, p, n, before, after))
        return F.when(F.size(ok) > 0, F.struct(F.get(ok, F.lit(0)).cast("int").alias("start"), (F.get(ok, F.lit(0)) + n).cast("int").alias("end")))

    near = F.when((n > 0) & (high > low), fuzzy(F.sequence(low, high - 1)))
    aligned = align(text, start, end, original, replacement, before, after)
    stands = F.coalesce((n > 0) & (slice_of(text, start, end) == original), F.lit(False))
    return F.when(~stands & (n > 0), F.coalesce(aligned, near))


def normalized_case(text: Column) -> Column:
    """White space as single blanks, trimmed; case as it is."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))

