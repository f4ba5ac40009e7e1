"""Where a Markdown text is prose and where it must not be touched.

A line scanner for the common block forms (fences, indented code, HTML blocks, tables, headings, quotes, lists,
paragraphs, reference definitions, footnotes) and for code spans, inline HTML and autolinks within prose.  Definitions are
neither prose nor forbidden; the text of a footnote is prose.  Not covered: definitions of several lines, and nesting of
several containers in one line beyond quotes, list marks and footnotes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselens.operators.ranges import merge_array
from proselens.operators.structure import blocks, plain_forbidden

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
QUOTE = re.compile(r" {0,3}> ?")
MARK = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
DEFINITION = re.compile(r" {0,3}\[(?!\^)(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
RAW_HTML = re.compile(r" {0,3}<(script|pre|style|textarea)(?:[\s>]|$)", re.IGNORECASE)
# Elements that begin an HTML block.
BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
HTML = re.compile(rf" {{0,3}}(?:</?(?:{BLOCK_TAGS})(?:[\s/>]|$)|<!--|<\?|<![A-Za-z])", re.IGNORECASE)
INLINE = re.compile(r"(?P<ticks>`+)|<!--.*?-->|<[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*>|<[\w.+\-]+@[\w.\-]+>|</?[A-Za-z][^<>]*>", re.DOTALL)

#: A text that matches may hold Markdown; one that does not is read natively.
SYNTAX = r"(?m)[`<|\\]|^(?: {4}|\t| {0,3}(?:#|>|~~~|[-*+_=]|[0-9]{1,9}[.)]|\[[^\]]+\]:))"


def scan(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(prose, forbidden) ranges of a text, in order."""
    prose: list[tuple[int, int]] = []
    forbidden: list[tuple[int, int]] = []
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    paragraph: list[tuple[int, int]] = []

    def close() -> None:
        if paragraph:
            add_prose(paragraph[0][0], paragraph[-1][1])
            paragraph.clear()

    def add_prose(a: int, b: int) -> None:
        if b > a:
            prose.append((a, b))
            inline(a, b)

    def inline(a: int, b: int) -> None:
        k = a
        while m := INLINE.search(text, k, b):
            if m["ticks"]:
                end = re.compile(rf"(?<!`){m['ticks']}(?!`)").search(text, m.end(), b)
                if not end:
                    k = m.end()
                    continue
                forbidden.append((m.start(), end.end()))
                k = end.end()
            else:
                forbidden.append((m.start(), m.end()))
                k = m.end()

    def inner(i: int) -> tuple[int, str, bool]:
        """Offset and rest of a line after quote and list marks; whether a list mark was there."""
        start, line = lines[i]
        marked = False
        while m := QUOTE.match(line) or FOOTNOTE.match(line) or (None if RULE.match(line) else MARK.match(line)):
            marked = marked or "> " not in m[0] + " " or not m[0].strip().startswith(">")
            start, line = start + m.end(), line[m.end() :]
            if not line:
                break
        return start, line, marked

    i = 0
    while i < len(lines):
        start, line, marked = inner(i)
        end = start + len(line)
        if marked:
            close()
        if not line.strip():
            close()
            i += 1
        elif m := FENCE.match(line):
            close()
            j = i + 1
            stop = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while j < len(lines) and not stop.match(inner(j)[1]):
                j += 1
            last = lines[min(j, len(lines) - 1)]
            forbidden.append((start, last[0] + len(last[1])))
            i = j + 1
        elif not paragraph and re.match(r"(?: {4}|\t)", line):
            j = i
            while j + 1 < len(lines) and (not lines[j + 1][1].strip() or re.match(r"(?: {4}|\t)", inner(j + 1)[1])):
                j += 1
            while not lines[j][1].strip():
                j -= 1
            forbidden.append((start, lines[j][0] + len(lines[j][1])))
            i = j + 1
        elif HEADING.match(line):
            close()
            lead = len(line) - len(line.lstrip())
            add_prose(start + lead, start + len(line.rstrip()))
            i += 1
        elif paragraph and UNDERLINE.match(line):
            paragraph.append((start, start + len(line.rstrip())))
            close()
            i += 1
        elif RULE.match(line):
            close()
            i += 1
        elif not paragraph and DEFINITION.match(line):
            i += 1
        elif (m := RAW_HTML.match(line)) or HTML.match(line):
            close()
            j = i
            if m:
                while j < len(lines) and f"</{m[1].lower()}>" not in lines[j][1].lower():
                    j += 1
            elif line.lstrip().startswith("<!--"):
                while j < len(lines) and "-->" not in lines[j][1]:
                    j += 1
            else:
                while j + 1 < len(lines) and lines[j + 1][1].strip():
                    j += 1
            j = min(j, len(lines) - 1)
            lead = len(line) - len(line.lstrip())
            forbidden.append((start + lead, lines[j][0] + len(lines[j][1])))
            i = j + 1
        elif "|" in line and not paragraph and i + 1 < len(lines) and DELIMITER.match(inner(i + 1)[1]) and "-" in lines[i + 1][1] and cells(line) == cells(inner(i + 1)[1]):
            j = i + 1
            while j + 1 < len(lines) and lines[j + 1][1].strip() and not FENCE.match(lines[j + 1][1]) and not HEADING.match(lines[j + 1][1]):
                j += 1
            forbidden.append((start, lines[j][0] + len(lines[j][1].rstrip())))
            i = j + 1
        else:
            lead = len(line) - len(line.lstrip())
            paragraph.append((start + lead, start + len(line.rstrip())))
            i += 1
    close()
    return prose, forbidden


def cells(line: str) -> int:
    return len(re.sub(r"\\\|", "", line).strip().strip("|").split("|"))


@F.pandas_udf(T.StructType([T.StructField("prose", RANGES), T.StructField("forbidden", RANGES)]))
def _scanned(texts: pd.Series) -> pd.DataFrame:
    found = [scan(t) if t is not None else (None, None) for t in texts]
    as_rows = lambda ranges: None if ranges is None else [{"start": a, "end": b} for a, b in ranges]
    return pd.DataFrame({"prose": [as_rows(p) for p, _ in found], "forbidden": [as_rows(f) for _, f in found]})


def with_structure(docs: DataFrame) -> DataFrame:
    """``docs`` with ``prose`` and ``forbidden``; only texts that may hold Markdown go to Python."""
    text = F.coalesce(F.col("text"), F.lit(""))
    syntax = text.rlike(SYNTAX)
    read = docs.withColumn("_md", _scanned(F.when(syntax, text)))
    plain = plain_forbidden(text)
    return read.withColumns(
        {
            "prose": merge_array(F.when(syntax, F.col("_md.prose")).otherwise(blocks(text))),
            "forbidden": merge_array(F.concat(F.coalesce(F.when(syntax, F.col("_md.forbidden")), F.array().cast(RANGES)), plain)),
        }
    ).drop("_md")


def masked(rows: Column, prose: Column, forbidden: Column) -> Column:
    """Rows inside prose that touch nothing forbidden."""
    from proselens.operators.ranges import intersects, within

    return F.filter(rows, lambda r: within(r["start"], r["end"], prose) & ~intersects(r["start"], r["end"], forbidden))
