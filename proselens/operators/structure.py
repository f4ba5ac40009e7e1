"""Text structure: paragraphs, sentences, chunks, links and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions.text import SPACE, WORD, let, slice_of, spans, trimmed_length
from proselens.operators.ranges import RANGE, merge_array
from proselens.plans.policy import DEFAULT, Policy

# Abbreviations that do not end a sentence.
ABBREVIATIONS = f"(?<![{WORD}])(?:e\\.g|i\\.e|Mr|Ms|Mrs|Dr|Prof|Sr|Jr|vs|approx)\\.\\z"


def _none() -> Column:
    return F.array().cast(f"array<{RANGE}>")


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def whole(text: Column) -> Column:
    """The whole text as one range; none for an empty text."""
    return F.when(F.length(text) > 0, F.array(_range(F.lit(0), F.length(text)))).otherwise(_none())


def paragraphs(text: Column, mode: str = "observed") -> Column:
    """Paragraphs, which end at two line feeds.

    observed: a paragraph holds the break, and the next begins two code points after it.  Every position followed by two line
    feeds counts, so three of them are two breaks.  intended: without the breaks, and from the break on.
    """
    skip = 2 if mode == "observed" else 0
    places = F.transform(spans(text, "\\n(?=\\n)"), lambda s: s["start"])
    first = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(a: Column, i: Column) -> Column:
        end = i + (2 if mode == "observed" else 0)
        found = F.when(end > a["at"], F.array_append(a["found"], _range(a["at"], end))).otherwise(a["found"])
        return F.struct((i + 2 + skip).alias("at"), found.alias("found"))

    def close(a: Column) -> Column:
        return F.when(a["at"] < F.length(text), F.array_append(a["found"], _range(a["at"], F.length(text)))).otherwise(a["found"])

    return F.aggregate(places, first, step, close)


def paragraph_of(start: Column, end: Column, found: Column) -> Column:
    """The number of the first paragraph that holds a range, 0 if none does."""
    numbers = F.transform(found, lambda p, i: F.when((start >= p["start"]) & (end <= p["end"]), i))
    return F.coalesce(F.array_min(numbers), F.lit(0))


def sentences(text: Column, mode: str = "observed") -> Column:
    """Sentence ranges.

    observed: touching sentences are merged, and as sentences always touch, the whole text is one.  intended: a sentence ends
    after ``.!?`` with the brackets, quotes and white space that follow (but not after common abbreviations), or
    after two line feeds.
    """
    if mode == "observed":
        return whole(text)
    ends = spans(text, f"\\n\\n|[.!?][)\\]\"'{SPACE}]*")
    real = F.filter(ends, lambda s: ~((s["match"].substr(1, 1) == ".") & F.substring(text, F.greatest(s["start"] - 7, F.lit(1)), F.least(s["start"] + 1, F.lit(9))).rlike(ABBREVIATIONS)))
    bounds = F.concat(F.array(F.lit(0)), F.transform(real, lambda s: s["end"]), F.array(F.length(text)))

    def between(b: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: _range(F.get(b, i - 1), F.get(b, i)))
        return F.filter(pairs, lambda r: r["end"] > r["start"])

    return let(bounds, between)


def sentence_span(text: Column, start: Column, end: Column, mode: str = "observed", around: int = 40) -> Column:
    """The sentence that holds a range, or else the one whose middle is nearest, with some code points on either side."""

    def nearest(found: Column) -> Column:
        def judged(s: Column) -> Column:
            holds = (start >= s["start"]) & (end <= s["end"])
            return F.struct(F.when(holds, 0).otherwise(1).alias("far"), F.when(holds, 0).otherwise(F.abs(s["start"] + s["end"] - start - end)).alias("by"), s.alias("s"))

        def widened(m: Column) -> Column:
            return F.when(m.isNotNull(), _range(F.greatest(m["s"]["start"] - around, F.lit(0)), F.least(m["s"]["end"] + around, F.length(text))))

        return let(F.array_min(F.transform(found, judged)), widened)

    return let(sentences(text, mode), nearest)


def is_sentence_start(text: Column, at: Column) -> Column:
    """Whether only blanks, quotes and opening brackets stand between a place and the last ``.!?``, line feed or start."""
    before = F.regexp_replace(slice_of(text, F.lit(0), at), f"[{SPACE}\"'“”‘’(\\[{{]+\\z", "")
    return (before == "") | before.rlike("[.!?\\n]\\z")


def addresses(text: Column) -> Column:
    """Bare http and https addresses."""
    return F.transform(spans(text, f"https?://[^{SPACE}]+"), lambda s: _range(s["start"], s["end"]))


def link_targets(text: Column) -> Column:
    """The bracketed targets of Markdown links: from the first ``(`` at or after the link's start to the ``)`` after it."""

    def target(s: Column) -> Column:
        opened = F.position(F.lit("("), text, s["start"] + 1) - 1
        closed = F.position(F.lit(")"), text, opened + 2) - 1
        return _range(opened, closed + 1)

    return F.transform(spans(text, f"\\[[^\\]]+\\]\\([^){SPACE}]+\\)"), target)


def plain_forbidden(text: Column) -> Column:
    """Forbidden ranges that need no Markdown reading: link targets and addresses, merged."""
    return merge_array(F.concat(link_targets(text), addresses(text)))


def blocks(text: Column) -> Column:
    """Prose of a text without Markdown: runs of lines between blank lines, without the white space at either end."""
    found = spans(text, f"(?:{_line()})(?:\\n{_line()})*")

    def bare(s: Column) -> Column:
        lead = F.length(s["match"]) - F.length(F.regexp_replace(s["match"], f"\\A[{SPACE}]+", ""))
        return _range(s["start"] + lead, s["start"] + trimmed_length(s["match"]))

    return F.transform(found, bare)


def _line() -> str:
    return f"[^\\n]*[^\\n{SPACE}][^\\n]*"


def chunks(text: Column, prose: Column, policy: Policy = DEFAULT, mode: str = "observed") -> Column:
    """Pieces for a model: array<struct<start, end, prefix_len>>.

    A short text is one piece.  Else each prose range is packed with sentences until the target length is reached, and
    a piece that begins inside its range has some of what is before it as a prefix.
    """
    kind = "array<struct<start:int,end:int,prefix_len:int>>"

    def piece(start: Column, end: Column, prefix: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), prefix.cast("int").alias("prefix_len"))

    everything = F.array(piece(F.lit(0), F.length(text), F.lit(0)))
    if mode == "observed":
        packed = F.transform(prose, lambda r: piece(r["start"], r["end"], F.lit(0)))
    else:

        def of_range(r: Column) -> Column:
            own = F.transform(sentences(slice_of(text, r["start"], r["end"]), mode), lambda s: _range(s["start"] + r["start"], s["end"] + r["start"]))
            none = F.array().cast(f"array<{RANGE}>")

            def step(done: Column, s: Column) -> Column:
                last = F.try_element_at(done, F.lit(-1))
                full = last.isNull() | (last["end"] - last["start"] >= policy.chunk_target)
                return F.when(full, F.array_append(done, s)).otherwise(F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), _range(last["start"], s["end"])))

            joined = F.aggregate(own, none, step)
            return F.transform(joined, lambda c: piece(c["start"], c["end"], c["start"] - F.greatest(r["start"], c["start"] - policy.chunk_overlap)))

        packed = F.flatten(F.transform(prose, of_range))
    whole_text = everything.cast(kind)
    usable = let(packed.cast(kind), lambda p: F.when(F.size(p) > 0, p).otherwise(whole_text))
    return F.when(F.length(text) <= policy.single_chunk, whole_text).otherwise(usable)


def chunk_rows(docs: DataFrame, prose: Column, policy: Policy = DEFAULT, mode: str = "observed", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, chunk_id, start, end, prefix_len and content (with the prefix)."""
    text = F.coalesce("text", F.lit(""))
    made = docs.select(key, text.alias("_t"), F.posexplode(chunks(text, prose, policy, mode)).alias("chunk_id", "c"))
    return made.select(key, "chunk_id", "c.*", slice_of(F.col("_t"), F.col("c.start") - F.col("c.prefix_len"), F.col("c.end")).alias("content"))


def prompt(content: Column, prefix_len: Column, items: int = 30) -> Column:
    """The request for a model about one piece of text."""
    rule = F.when(prefix_len > 0, F.concat(F.lit(" The first "), prefix_len.cast("string"), F.lit(" characters are context only: suggest nothing there."))).otherwise("")
    return F.concat(F.lit(f"List at most {items} corrections of spelling, spacing, punctuation and style in the text, as JSON with the key suggestions; ranges count characters from 0."), rule, F.lit("\n\n"), content)
