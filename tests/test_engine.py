"""Cases worked out by hand: rules, selection and gate, structure, edits, model rows, alignment, streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proselens.functions import markdown
from proselens.functions import text as T
from proselens.operators import alignment, edits, gate, incremental, model_rows, ranges, rules, structure
from proselens.plans.analysis import analyse
from proselens.sources import documents
from proselens.streaming import edits as stream

TAIL = " The quick report was read by many people in the old town hall and it was found to be clear, short, honest, useful, well made, and kind to all of the new staff who had come from far away to help us build it."

FINAL = {
    "Hello,world": [(3, 11, 11, ".")],
    "I recieve  it.": [(11, 2, 9, "receive"), (1, 9, 11, " ")],
    "recieve it.": [],
    "a  b  c.": [(1, 1, 3, " ")],
    "Wait...": [(7, 4, 7, ".")],
    "Go - now.": [],
    "Hi the the.": [],
    "Note:  this": [(1, 5, 7, " "), (3, 11, 11, ".")],
    "Hi , you.": [(2, 2, 3, "")],
    "A b  : c.": [(1, 3, 5, " ")],
    "Hello ": [(3, 5, 6, ". ")],
    "go on." + TAIL: [(6, 0, 1, "G")],
    "Yes A... B... Ok." + TAIL: [(7, 5, 8, "."), (10, 10, 13, "…")],
    "Wow!! It is is fine." + TAIL + " We saw the the end.": [(7, 3, 5, "!"), (4, 9, 14, "is")],
    "One - two." + TAIL: [],
    "": [],
    "   ": [(1, 0, 3, " ")],
}


def test_final_rows(spark):
    texts = list(FINAL)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = gate.as_rows(docs, gate.final_local(F.col("text"))).orderBy("doc_id", "ord").collect()
    for i, t in enumerate(texts):
        assert [(r.rule, r.start, r.end, r.replacement) for r in found if r.doc_id == i] == FINAL[t], t


def test_spans_give_back_their_match(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = rules.scan(docs).join(docs, "doc_id")
    assert rows.where("substring(text, start + 1, end - start) <> original or start < 0 or end > length(text)").count() == 0


def test_prefix_moves_spans(spark):
    docs = spark.createDataFrame([(1, "It is is so , yes.."), (2, "Ab cd. It is is so , yes..")], "doc_id long, text string")
    rows = rules.scan(docs).select("doc_id", "rule", "start").collect()
    assert sorted((r.rule, r.start + 7) for r in rows if r.doc_id == 1) == sorted((r.rule, r.start) for r in rows if r.doc_id == 2)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pairs(rows):
    return [(r["start"], r["end"]) for r in rows]


def test_structure(spark):
    assert pairs(one(spark, structure.paragraphs(F.lit("Aa.\n\nBb.")))) == [(0, 5), (7, 8)]
    assert pairs(one(spark, structure.paragraphs(F.lit("a\n\n\nb\n\n c")))) == [(0, 3), (6, 7)]
    assert pairs(one(spark, structure.sentences(F.lit("A b. C d.")))) == [(0, 9)]
    assert pairs(one(spark, structure.sentences(F.lit("Dr. No! ok"), "intended"))) == [(0, 8), (8, 10)]
    assert pairs(one(spark, structure.link_targets(F.lit("see [a(b](https://e.x/a_b) x")))) == [(6, 26)]
    assert one(spark, structure.is_sentence_start(F.lit('Hi. "Yes'), F.lit(5)))
    assert not one(spark, structure.is_sentence_start(F.lit("Hi no"), F.lit(3)))


def test_ranges(spark):
    given = F.expr("array(struct(7 as start, 9 as end), struct(0 as start, 3 as end), struct(3 as start, 5 as end))")
    assert pairs(one(spark, ranges.merge_array(given))) == [(0, 5), (7, 9)]
    assert tuple(one(spark, ranges.change_span(F.lit("abc"), F.lit("abXc")))) == (2, 2, 3)
    assert one(spark, ranges.change_span(F.lit("a"), F.lit("a"))) is None
    assert tuple(one(spark, ranges.change_span(F.lit("aaaa"), F.lit("aaa")))) == (3, 4, 3)


@pytest.mark.parametrize(("n", "expected"), [(0, 6), (6, 6), (7, 2), (14, 4), (20, 6)])
def test_budget(spark, n, expected):
    assert one(spark, gate.style_budget(F.lit(1500), F.lit(n))) == expected


def test_tokens_and_graphemes(spark):
    assert one(spark, T.token_distance(F.lit(" - n"), F.lit("o—n"))) == 2
    assert one(spark, T.tokens(F.lit("la laé 12x!"))) == ["la", "laé", "12", "x", "!"]
    assert tuple(one(spark, T.snapped(F.lit("a\U0001F3FD́b"), F.lit(1), F.lit(2)))) == (0, 3)
    assert one(spark, T.utf16_offset(F.lit("a\U0001F600b"), F.lit(2))) == 3


def test_edits(spark):
    docs = spark.createDataFrame([(1, "Hello"), (2, "Go - now."), (3, "I recieve  it.")], "doc_id long, text string")
    rows = gate.full_rows(rules.local_rows(F.col("text")))
    pick = F.element_at(F.filter(rows, lambda r: r["rule"].isin(3, 9, 11)), 1)
    found = docs.select("doc_id", *(edits.applied(F.col("text"), pick, m).alias(m) for m in ("observed", "intended")), edits.applied_all(F.col("text"), rows).alias("all"))
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, "Hell.", "Hello.", "Hello."), (2, "Goo—now.", "Go—now.", "Go - now."), (3, "I receive  it.", "I receive  it.", "I receive it.")]
    edited = spark.createDataFrame([("I receive  it.",)], "text string")
    row = F.struct(*(F.lit(v).alias(n) for n, v in (("start", 2), ("end", 9), ("original", "recieve"), ("replacement", "receive"))), *(F.lit(None).cast("string").alias(n) for n in ("before", "after")))
    assert edited.select(edits.reverted(F.col("text"), row).alias("x")).first().x == "I recieve  it."


def test_alignment(spark):
    none = F.lit(None).cast("string")

    def at(text, start, end, original, replacement="x", before=none, after=none):
        r = one(spark, alignment.align(F.lit(text), F.lit(start), F.lit(end), F.lit(original), F.lit(replacement), before, after))
        return None if r is None else tuple(r)

    assert at("aXaXa", 0, 1, "a") == (0, 1)
    assert at("foo bar foo", 5, 8, "foo") == (8, 11)
    assert at("foo bar foo", 5, 8, "foo", before=F.lit("")) == (8, 11)
    assert at("foo bar foo", 7, 8, "foo", after=F.lit(" bar")) == (0, 3)
    assert at("one. the end the", 12, 15, "the", "The") == (5, 8)
    assert at("abc", 0, 1, "zz") is None
    assert at("abc", 0, 1, "") is None
    moved = one(spark, alignment.relocate(F.lit("so many  words here"), F.lit(0), F.lit(3), F.lit("many words"), F.lit("x"), none, none))
    assert tuple(moved) == (2, 12)


RAW = """```json
{"suggestions": [
 {"range": {"start": 2, "end": 9}, "original": "recieve", "replacement": "receive", "category": "spelling", "confidence": 0.9},
 {"range": {"start": "2", "end": 3}}, {"title": "no range"},
 {"range": {"start": 0, "end": 3}, "original": "it.", "replacement": "that.", "category": "zzz", "severity": "loud", "confidence": 1.5},
 {"range": {"start": 0, "end": 1}, "replacement": "%s"},
 {"range": {"start": 3, "end": 3}, "replacement": "?", "category": "style"}]}
```""" % ("y" * 401)


def test_model_rows(spark):
    docs = spark.createDataFrame([(1, "I recieve it."), (2, None)], "doc_id long, text string")
    raw = spark.createDataFrame([(1, 0, 0, 0, RAW), (1, 1, 0, 0, "nonsense"), (2, 0, 0, 0, '{"suggestions": {}}')], "doc_id long, chunk_id int, chunk_start int, prefix_len int, raw string")
    found = model_rows.accepted(raw, docs).orderBy("item").collect()
    assert [(r.item, r.start, r.end, r.category, r.severity, r.confidence) for r in found] == [(0, 2, 9, "spelling", "info", 0.9), (3, 10, 13, "other", "info", None)]
    assert {r.stage: r.n for r in model_rows.stages(raw, docs).collect()} == {"parsed": 6, "with_range": 4, "after_prefix": 4, "in_place": 4, "found": 4, "kept": 2}
    both = analyse(docs, raw).where("source = 'ai'").collect()
    assert [(r.start, r.title) for r in both] == [(10, "Suggestion")]  # the other one overlaps a local row
    made = model_rows.call(docs.select("doc_id", F.lit("p").alias("prompt")), lambda p: p * 2).collect()
    assert [r.raw for r in made] == ["pp", "pp"]


MD = "# Head  line\n\nSome `code  x` and <b>bold</b> <https://a.b/c>.\nmore\n\n```py\nx  =  1\n```\n\n    code\n\n| a | b |\n|---|---|\n| 1  | 2 |\n\n- item  one\n- two\n\n> quoted\n\n<div>\nhtml\n</div>\n\nSetext\n===\n\n***\nend"


def test_markdown(spark):
    prose, forbidden = markdown.scan(MD)
    assert [MD[a:b] for a, b in prose] == ["# Head  line", "Some `code  x` and <b>bold</b> <https://a.b/c>.\nmore", "item  one", "two", "quoted", "Setext\n===", "end"]
    assert [MD[a:b] for a, b in forbidden] == ["`code  x`", "<b>", "</b>", "<https://a.b/c>", "```py\nx  =  1\n```", "    code", "| a | b |\n|---|---|\n| 1  | 2 |", "<div>\nhtml\n</div>"]
    docs = spark.createDataFrame([(1, MD), (2, "```\na  b\n```"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in analyse(docs).collect()} == {1}


def test_sources(spark, sf_dir):
    docs = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "y" * 100_001)], "doc_id long, text string")
    assert {(r.doc_id, r.status) for r in documents.rejects(docs).collect()} == {(2, 400), (3, 400), (4, 413)}
    assert documents.read(spark, f"{sf_dir}/documents.parquet").columns == ["doc_id", "text"]
    body = documents.as_json(analyse(spark.createDataFrame([(1, "Wait  a..")], "doc_id long, text string"))).first().body
    assert body.startswith('{"suggestions":[{"ord":0')


def test_incremental(spark):
    pairs_ = spark.createDataFrame([(1, "abc", "abXc"), (2, None, "q"), (3, "a", "  "), (4, "a", "b" * 2000)], "doc_id long, old string, new string")
    assert {r.doc_id: r.route for r in incremental.routed(pairs_).collect()} == {1: "scoped", 2: "full", 3: "none", 4: "full"}
    scope = one(spark, incremental.scoped(F.lit("abcdef"), F.lit(5), F.lit(5)))
    assert tuple(scope) == (0, "abcdef")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "Helo"), (1, "2024-01-01 00:00:00.2", 2, "Hello  you"), (2, "2024-01-01 00:00:01", 1, "Yes.."), (9, "2024-01-01 01:00:00", 1, "end")]
    spark.createDataFrame(rows, "doc_id long, ts string, version int, text string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, ts timestamp, version int, text string").parquet(str(tmp_path / "in"))
    running = stream.settled(source).writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination(120)
    settled = spark.table("settled")
    assert {(r.doc_id, r.text, r.edits) for r in settled.collect()} >= {(1, "Hello  you", 2), (2, "Yes..", 1)}
    found = stream.suggestions(settled.where("doc_id < 9")).collect()
    assert {(r.doc_id, r.rule) for r in found} == {(1, 1), (1, 3), (2, 7)}
