"""Queries without SQL against brute force: nothing of a table is left out."""

from __future__ import annotations

from proselens.operators import edits, gate
from proselens.plans import registry


def placed(text, r):
    """Where the client finds a suggestion again: the given range, or else the nearest occurrence."""
    n = len(r.original)
    if not n or text[r.start : r.end] == r.original:
        return r.start, r.end
    found = [p for p in range(len(text)) if text.startswith(r.original, p)]
    at = min(found, key=lambda p: (abs(p - r.start), p))
    return at, at + n


def table(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_apply_all_takes_every_suggestion(spark, tmp_path):
    from hashlib import sha256

    texts = [" ".join(f"Part {i} ended!! Then  more came." for i in range(40)), "It was fine.", "Wait.. what  now."]
    at = table(spark, tmp_path, texts)
    rows = registry.QUERIES["q_final_local"](spark, at).where("category <> 'style'").orderBy("doc_id", "start").collect()
    assert sum(r.doc_id == 0 for r in rows) > 20
    edited = list(texts)
    for r in rows:
        start, end = placed(edited[r.doc_id], r)
        if start == end == len(edited[r.doc_id]):
            start -= 1  # a range at the end of a text is widened to its last character
        edited[r.doc_id] = edited[r.doc_id][:start] + r.replacement + edited[r.doc_id][end:]
    assert "!!" not in edited[0] and "  " not in edited[0]
    got = {r.doc_id: r.edited_sha256 for r in registry.QUERIES["q_apply_all_observed"](spark, at).collect()}
    assert got == {i: sha256(t.encode()).hexdigest() for i, t in enumerate(edited)}


def test_change_span_of_long_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert any(len(t) >= 3000 for t in texts.values())
    expected = {}
    for i, a in texts.items():
        b = a[: len(a) // 2] + "XY" + a[len(a) // 2 + 3 :]
        least = min(len(a), len(b))
        p = next((k for k in range(least) if a[k] != b[k]), least)
        s = next((k for k in range(least - p) if a[-1 - k] != b[-1 - k]), least - p)
        if a != b:
            expected[i] = (p, len(a) - s, len(b) - s)
    got = {r.doc_id: (r.start, r.end_a, r.end_b) for r in registry.QUERIES["q_change_span"](spark, sf_dir).collect()}
    assert got == expected


def test_token_distance_of_all_rules(spark, tmp_path):
    import re

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    def tokens(text):
        return re.findall(r"[^\W\d_]+|[0-9]+|\S", text)

    at = table(spark, tmp_path, ["Hello,world and more", "i recieve it . ok", "One - two is is fine!! the end", "go on", "Wait... Yes A... b ,c"])
    rows = registry.QUERIES["q_local_all"](spark, at).collect()
    assert {r.rule for r in rows} - {4, 7}
    expected = {(r.doc_id, r.ord): distance(tokens(r.original or ""), tokens(r.replacement or "")) for r in rows}
    got = {(r.doc_id, r.ord): r.changed for r in registry.QUERIES["q_token_distance"](spark, at).collect()}
    assert got == expected


def test_snap_reaches_all_of_a_text(spark, tmp_path):
    clusters = [["a", "é", "b", "\U0001f44d\U0001f3fd", "\n", "क्", "x"] * 30, list("short"), [], ["é"] * 200]
    texts = ["".join(c) for c in clusters]
    at = table(spark, tmp_path, texts)
    expected = set()
    for i, c in enumerate(clusters):
        n, starts = len(texts[i]), [sum(map(len, c[:k])) for k in range(len(c))]
        for p in {*range(0, n + 1, 32), n}:
            high = min((s for s in starts if s >= p + 2), default=n)
            expected.add((i, p, max((s for s in starts if s <= p), default=0), high))
    got = [(r.doc_id, r.place, r.start, r.end) for r in registry.QUERIES["q_grapheme_snap"](spark, at).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_apply_all_in_order_is_the_fold(spark, sf_dir):
    """The Arrow pass against the expression that applies one row after the other, and every document by its length."""
    from pyspark.sql import functions as F

    texts = ["Go - now..  Then  it it was é\u0301!! ok", "a  b ,c.D recieve  it", "", "Wait... A... b", "It is is so", "end  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rows", gate.full_rows(registry.rules.local_rows(F.col("text"))))
    got = {r.doc_id: r.text for r in edits.applied_in_order(docs).collect()}
    want = {r.doc_id: r.t for r in docs.select("doc_id", edits.applied_all(F.col("text"), F.col("rows"), "observed").alias("t")).collect()}
    assert got == want
    assert edits.snap("a\u0301b", 1, 1) == (0, 2) and edits.snap("ab", 2, 2) == (1, 2) and edits.snap("abc", 1, 1) == (1, 1) and edits.snap("", 0, 0) == (0, 0)
    every = registry.QUERIES["q_apply_all_observed"](spark, sf_dir).collect()
    assert len(every) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r.edited_sha256 for r in every)


def test_model_calls(spark):
    from proselens.operators import model_rows

    def client(prompt):
        if prompt.startswith("no"):
            raise model_rows.Refused(int(prompt[2:]), "refused")
        if prompt == "broken":
            raise ValueError("broken")
        return prompt.upper()

    asked = spark.createDataFrame([(0, "a"), (1, "no429"), (2, "no418"), (3, "broken"), (4, "no401")], "doc_id long, prompt string")
    got = {r.doc_id: (r.raw, r.error, r.status) for r in model_rows.call(asked, client, at_once=2, per_second=50).collect()}
    assert got == {0: ("A", None, 200), 1: (None, "refused", 429), 2: (None, "refused", 502), 3: (None, "broken", 502), 4: (None, "refused", 401)}


def test_observed_originals_follow_the_place(spark):
    """After a row is left out, the observed way takes the original of another item."""
    import json

    from proselens.operators import model_rows

    text = "one two three four"
    items = [{"range": {"start": 0, "end": 3}, "original": "one", "replacement": "x"}, {"range": {"start": 8, "end": 13}, "original": "three", "replacement": "y"}, {"range": {"start": 14, "end": 18}, "original": "four", "replacement": "z"}]
    raw = spark.createDataFrame([(1, 0, 0, 4, json.dumps({"suggestions": items}))], "doc_id long, chunk_id int, chunk_start int, prefix_len int, raw string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")

    def found(mode):
        return sorted((r.item, r.start, r.end) for r in model_rows.accepted(raw, docs, mode=mode).collect())

    assert found("intended") == [(1, 8, 13), (2, 14, 18)]
    assert found("observed") == [(1, 0, 3), (2, 8, 13)]


def test_cache_metrics_settings(spark, sf_dir):
    from proselens.operators import incremental, rules
    from proselens.plans import metrics
    from proselens.plans.policy import Policy

    asked = [(0, 0, 0.0, "a"), (0, 1, 1.0, "a"), (0, 2, 2.0, "b"), (0, 3, 3.0, "a"), (0, 4, 4.0, "c"), (0, 5, 5.0, "b"), (0, 6, 200.0, "a"), (1, 7, 1.0, "a")]
    got = {r.seq: r.hit for r in incremental.cached(spark.createDataFrame(asked, "node int, seq int, at double, text_key string"), cap=2, seconds=100).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    rows, seen = metrics.counted(rules.scan(registry.docs(spark, sf_dir)))
    n = rows.count()
    assert seen.get["rows"] == n == sum(v for k, v in seen.get.items() if k.startswith("category_"))
    assert metrics.clipped("x" * 200) == "x" * 160 + "…" and metrics.clipped(None) == ""
    policy = Policy().with_settings({"proselens.max_text": "5", "proselens.enable_style": "no", "proselens.allowed_kinds": "case, wording", "other": "1"})
    assert (policy.max_text, policy.enable_style, policy.allowed_kinds, policy.min_confidence) == (5, False, ("case", "wording"), 0.55)


def test_long_runs_of_matches(spark):
    import time

    from pyspark.sql import functions as F

    from proselens.functions.text import spans

    df = spark.createDataFrame([("ab. " * 32_000,)], "t string")
    began = time.time()
    found = df.select(spans(F.col("t"), "[.]").alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1)["start"].alias("last")).first()
    assert (found.n, found.last) == (32_000, 4 * 32_000 - 2) and time.time() - began < 10


def test_definitions_and_footnotes():
    from proselens.functions.markdown import scan

    text = "Some prose.\n\n[one]: http://a.org/x 'Title'\n[two]: <b c>\n\n[^1]: A note, `code` in it.\n\nnot [a]: definition\n[b]: in a paragraph"
    prose, forbidden = scan(text)
    assert [text[a:b] for a, b in prose] == ["Some prose.", "A note, `code` in it.", "not [a]: definition\n[b]: in a paragraph"]
    assert [text[a:b] for a, b in forbidden] == ["`code`"]
