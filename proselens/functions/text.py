"""Text functions: regular-expression spans with offsets, tokens, letters and edit distances, all built in.

Offsets count code points.  Patterns spell out what a word character (ASCII) and white space (Unicode) are, because the
shorthands of Java mean other sets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "A-Za-z0-9_"
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
INLINE_SPACE = SPACE.replace("\\n", "")
TOKEN = f"\\p{{L}}+|[0-9]+|[^{SPACE}]"

SPAN = "struct<start:int,end:int,match:string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas do not share common parts of expressions by themselves."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, block: int = 64) -> Column:
    """The sums of the first 1, 2, ... values of an array of ints, in steps of blocks: appending copies a block at most."""

    def summed(a: Column, v: Column) -> Column:
        return F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"] + v).alias("out"))

    def based(a: Column, b: Column) -> Column:
        return F.struct((a["at"] + b["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(block)), lambda i: F.aggregate(F.slice(v, i + 1, block), zero, summed))

    def joined(b: Column) -> Column:
        bases = F.aggregate(b, zero, based, lambda a: a["out"])
        return F.flatten(F.transform(F.arrays_zip(b.alias("b"), bases.alias("base")), lambda x: F.transform(x["b"]["out"], lambda v: v + x["base"])))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(none))


def spans(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches, leftmost and without overlap, as array<struct<start, end, match>>.

    The text is split at the matches; a match ends where the pieces and matches up to it end.  ``hint`` is a pattern that
    is found sooner and without which there is no match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        ends = running(F.zip_with(gaps, m, lambda g, x: F.length(g) + F.length(x)))
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("match")))

    return F.when(text.rlike(hint or pattern), let(matches, placed)).otherwise(none)


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def trimmed_length(text: Column) -> Column:
    """The length of a text without the white space at its end."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+\\z", ""))


def normalized(text: Column) -> Column:
    """White space as single blanks, trimmed, lower case; null is empty."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")
    return F.lower(F.trim(one))


def tokens(text: Column) -> Column:
    """Runs of letters, runs of ASCII digits, and single other characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{L}"))


def has_letter(text: Column) -> Column:
    return text.rlike("\\p{L}")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over tokens: each distinct token becomes one character of the CJK block (20,000 fit)."""

    def written(list_: Column, words: Column) -> Column:
        codes = F.transform(list_, lambda t: F.lpad(F.hex(F.array_position(words, t) + 19968), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

    def measured(x: Column) -> Column:
        words = F.array_distinct(F.concat(x["a"], x["b"]))
        return F.levenshtein(written(x["a"], words), written(x["b"], words))

    pair = F.struct(tokens(F.coalesce(a, F.lit(""))).alias("a"), tokens(F.coalesce(b, F.lit(""))).alias("b"))
    return let(pair, measured)


def checksum(original: Column) -> Column:
    """SHA-256 of a text that is not empty."""
    return F.when(F.length(original) > 0, F.sha2(original, 256))


def grapheme_starts(text: Column) -> Column:
    """The start offset of each grapheme cluster."""
    return F.transform(spans(text, "\\X"), lambda s: s["start"])


def snapped(text: Column, start: Column, end: Column) -> Column:
    """A range widened to grapheme boundaries: the last start not after ``start``, the first not before ``end``.

    Clusters are counted only between the nearest places on both sides that are boundaries for certain (between two
    characters of ASCII), so a range in a long text does not cost the text's clusters.
    """
    plain = "[\\n -~]"
    low, high = F.greatest(F.least(start, end), F.lit(0)), F.greatest(start, end, F.lit(0))
    left, right = F.greatest(low - 48, F.lit(0)), high
    before = F.length(F.regexp_extract(slice_of(text, left, low + 1), f"(?s)^(.*{plain}){plain}", 1))
    after = F.length(F.regexp_extract(slice_of(text, right, high + 48), f"(?s)^(.*?{plain}){plain}", 1))
    window = F.struct(
        F.when(before > 0, left + before).otherwise(0).cast("int").alias("low"),
        F.when(after > 0, right + after).otherwise(F.length(text)).cast("int").alias("high"),
    )

    def scanned(w: Column) -> Column:
        def step(a: Column, n: Column) -> Column:
            reached = F.coalesce(a["high"], F.when(a["at"] >= end, a["at"]))
            is_low = (a["at"] <= start) & (a["high"].isNull() | (a["at"] == a["high"]))
            return F.struct((a["at"] + n).alias("at"), F.when(is_low, a["at"]).otherwise(a["low"]).alias("low"), reached.alias("high"))

        clusters = F.regexp_extract_all(slice_of(text, w["low"], w["high"]), F.lit("\\X"), F.lit(0))
        begin = F.struct(w["low"].alias("at"), w["low"].alias("low"), F.lit(None).cast("int").alias("high"))
        return F.aggregate(F.transform(clusters, lambda c: F.length(c)), begin, step, lambda a: F.struct(a["low"].alias("start"), F.coalesce(a["high"], w["high"]).alias("end")))

    return let(window, scanned)


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code-point offset in UTF-16 units, for clients that count those."""
    return (F.length(F.encode(slice_of(text, F.lit(0), offset), "UTF-16BE")) / 2).cast("int")
