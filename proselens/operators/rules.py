"""The deterministic rules: each scans a text for spans and says what to put there.

A rule is a pattern, the part of the match that is its span, and a replacement made from the match.  Rules know nothing
of each other; their rows may overlap.  Everything is one expression over the text, so a scan is a projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions.text import INLINE_SPACE, SPACE, WORD, spans, trimmed_length

# The spelling list.
MISSPELLINGS = {
    "recieve": "receive",
    "accomodate": "accommodate",
    "seperate": "separate",
    "definately": "definitely",
    "occured": "occurred",
    "occurance": "occurrence",
}

_LINE_START = "\\A|[\\n\\r\\u2028\\u2029]"


def _spelled(match: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MISSPELLINGS.items() for x in pair))
    return F.element_at(known, F.lower(match))


@dataclass(frozen=True)
class Rule:
    """One rule; ``cut_left``/``cut_right``: how much of the match's ends is outside of the span (None: all but one);
    ``hint``: see ``spans``."""

    number: int
    name: str
    title: str
    category: str
    severity: str
    pattern: str
    replacement: Callable[[Column], Column]
    message: Callable[[Column], Column]
    cut_left: int | None = 0
    cut_right: int = 0
    hint: str | None = None


def _say(text: str) -> Callable[[Column], Column]:
    return lambda match: F.lit(text)


def _put(text: str) -> Callable[[Column], Column]:
    return lambda match: F.lit(text)


# Titles, categories, severities and what each rule looks for.
RULES = [
    Rule(1, "multi_space", "Change the spacing", "spacing", "info", f"[{INLINE_SPACE}]{{2,}}", _put(" "), _say("Several spaces in a row: one is enough.")),
    Rule(2, "space_before_punct", "Use correct spacing", "spacing", "info", f"[{SPACE}]+[,.!?;:](?![{WORD}])", _put(""), _say("No space belongs before this mark."), cut_right=1),
    Rule(4, "repeated_word", "Repeated word", "style", "info", f"(?i)(?<![{WORD}])([{WORD}]+)[{SPACE}]+\\1(?![{WORD}])", lambda m: F.regexp_extract(m, f"^[{WORD}]+", 0), lambda m: F.concat(F.lit("The word \""), F.regexp_extract(m, f"^[{WORD}]+", 0), F.lit("\" stands twice."))),
    Rule(5, "space_after_punct", "Add space after punctuation", "spacing", "info", "[,.!?;:]\\p{L}", lambda m: F.concat(F.substring(m, 1, 1), F.lit(" "), F.substring(m, 2, 1)), _say("A space belongs after this mark.")),
    Rule(6, "capitalize", "Capitalize sentence", "style", "info", f"(?:{_LINE_START}|[.!?][{SPACE}]+)[a-z]", lambda m: F.upper(F.right(m, F.lit(1))), _say("Begin the sentence with a capital letter."), cut_left=None),
    Rule(7, "repeated_punct", "Reduce punctuation", "punctuation", "info", "([.!?])\\1+", lambda m: F.substring(m, 1, 1), _say("One mark is enough.")),
    Rule(8, "colon_space", "Normalize colon spacing", "spacing", "info", f":[{SPACE}]{{2,}}", _put(" "), _say("One space after a colon is enough."), cut_left=1),
    Rule(9, "em_dash", "Use an em dash", "style", "info", f"[^{SPACE}][{SPACE}]-[{SPACE}][^{SPACE}]", lambda m: F.concat(F.substring(m, 1, 1), F.lit("—"), F.right(m, F.lit(1))), _say("A dash is meant here: use an em dash."), cut_left=1, hint=f"-[{SPACE}]"),
    Rule(10, "ellipsis", "Use ellipsis character", "style", "info", "\\.\\.\\.", _put("…"), _say("Three dots have a character of their own.")),
    Rule(11, "misspelling", "Spelling", "spelling", "warn", f"(?i)(?<![{WORD}])(?:{'|'.join(MISSPELLINGS)})(?![{WORD}])", _spelled, lambda m: F.concat(F.lit("\""), m, F.lit("\" is spelled \""), _spelled(m), F.lit("\"."))),
]
MISSING_PERIOD = Rule(3, "missing_period", "Punctuation mistake", "punctuation", "warn", "", _put("."), _say("The text ends without a mark."))
BY_NAME = {r.name: r for r in [*RULES, MISSING_PERIOD]}

ROW = "struct<start:int,rule:int,end:int,original:string,replacement:string,title:string,message:string,category:string,severity:string>"


def _row(r: Rule, start: Column, end: Column, original: Column, replacement: Column, message: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(r.number).alias("rule"), end.cast("int").alias("end"), original.alias("original"), replacement.alias("replacement"),
        F.lit(r.title).alias("title"), message.alias("message"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
    )


def rule_rows(text: Column, r: Rule) -> Column:
    """The rows of one rule on a text, as an array in the order of the text."""
    if r.number == MISSING_PERIOD.number:
        end, bare = F.length(text), trimmed_length(text)
        due = (bare > 0) & ~F.substring(text, bare, F.lit(1)).isin(".", "!", "?")
        fill = F.rpad(F.lit("."), (end - bare + 1).cast("int"), F.lit(" "))
        row = _row(r, bare, end, F.substring(text, bare + 1, end - bare), fill, r.message(text))
        return F.when(due, F.array(row)).otherwise(F.array().cast(f"array<{ROW}>"))

    def row(s: Column) -> Column:
        left = F.length(s["match"]) - 1 if r.cut_left is None else F.lit(r.cut_left)
        start, end = s["start"] + left, s["end"] - r.cut_right
        return _row(r, start, end, F.substring(s["match"], left + 1, end - start), r.replacement(s["match"]), r.message(s["match"]))

    return F.transform(spans(text, r.pattern, r.hint), row)


def local_rows(text: Column) -> Column:
    """The rows of all rules by start and then by rule (rules have titles of their own, so no row comes twice)."""
    every = F.flatten(F.array(*(rule_rows(text, BY_NAME[n]) for n in sorted(BY_NAME, key=lambda n: BY_NAME[n].number))))
    return F.array_sort(every)


def exploded(docs: DataFrame, rows: Column, key: str = "doc_id") -> DataFrame:
    """One row per array element: the key, its fields, ``ord`` (its number in the document) and derived columns."""
    found = docs.select(key, F.posexplode(rows).alias("ord", "s")).select(key, "ord", "s.*")
    return found.select(
        key,
        F.sha2(F.concat_ws("|", key, "start", "end", "title", "replacement"), 256).alias("suggestion_id"),
        "ord", "rule", "title", "message", "category", "severity", "start", "end", "original", "replacement",
        F.lit("local").alias("source"),
        F.when(F.length("original") > 0, F.sha2("original", 256)).alias("checksum"),
    )


def scan(docs: DataFrame, name: str | None = None) -> DataFrame:
    """Suggestion rows of one rule, or of all, on every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    return exploded(docs, rule_rows(text, BY_NAME[name]) if name else local_rows(text))
