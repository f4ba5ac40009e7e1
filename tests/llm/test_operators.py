"""The training-data operators against brute force and by hand, with nulls, empty, very long and repeated texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import compared
from pyspark.sql import functions as F

from proselens.llm import decontamination, html_text, licenses, line_dedup, near_dedup, neighbours, pieces, repeats, sharding, toxicity
from proselens.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score double, shard int, h string"  # with columns that clash with the operators' own


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def story(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice(["", "a", "e", "i", "o"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = story(1, 120)
    edited = base.split(" ")
    edited[60] = "CHANGED"
    texts = [base, base, " ".join(edited), None, "", "", "one", "All rights reserved. CC by, cc BY!", "line a b c d e f g h\nline a b c d X f g h\n\nline a b c d e f g h", "x" * 300_000, base + "\n" + story(2, 30), story(3, 20_000), "éß日本 " * 50]
    rows = [(i, t, 0.5, 7, "clash") for i, t in enumerate(texts)] + [(0, texts[0], 0.5, 7, "clash"), (None, "no id", 0.1, 1, "x"), (None, None, 0.1, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_queries_registered():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    mine, other = compared(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
    assert mine == other


def test_toxicity(spark, odd, empty):
    found = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = found.join(labels, "doc_id").where("held_out").collect()
    clean, toxic = [r.score for r in got if not r.toxic], [r.score for r in got if r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    assert np.mean([s < 0.5 for s in clean]) > 0.97
    labels = spark.createDataFrame([(0, 1, 1), (2, 0, 0), (6, None, 1), (0, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(empty, none).count() == 0 and {r.score for r in toxicity.score(odd, none).collect()} == {0.5}


def shingles(text):
    w = words(text)
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def similarity(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[k] / x[d], y[k] / y[d]) for k in every) for d in set(x) & set(y))


def test_near_dedup(spark, odd, empty):
    rng = random.Random(5)
    texts = []
    for group in range(6):
        base = story(100 + group, 60).split(" ")
        for _ in range(12):
            copy = [f"z{rng.random()}" if rng.random() < rng.choice([0.005, 0.02, 0.06]) else w for w in base]
            texts.append(" ".join(copy + base[:10] * rng.choice([0, 0, 1])))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}
    found = near_dedup.classes(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r.class_id for r in found if r.doc_id is not None}
    assert by_id[1] == 0 and by_id[4] == by_id[5] == by_id[3] == 3 and by_id[6] == 6
    assert all(r.class_id is None for r in found if r.doc_id is None)
    assert near_dedup.classes(empty).count() == 0


def test_representatives(spark, odd, empty):
    texts = [story(1, 60), story(2, 60), story(3, 60), ""]
    rows = [(1, texts[0], 0.5, 1, "a"), (1, texts[1], 0.5, 1, "a"), (2, texts[0] + " x", 0.5, 1, "a"), (3, texts[2], 0.5, 1, "b"), (3, texts[2], 0.5, 1, "a"), (None, texts[0], 0.5, 1, "a"), (None, texts[0], 0.5, 1, "a"), (4, None, 0.5, 1, "a"), (5, "", 0.5, 1, "a"), (0, texts[1], 0.5, 1, "a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("clash")).withColumn("own", F.lit(3))
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.h) for r in kept.collect()), key=repr) == sorted([(1, texts[0], "a"), (3, texts[2], "a"), (None, texts[0], "a"), (None, texts[0], "a"), (4, None, "a"), (0, texts[1], "a")], key=repr)
    assert near_dedup.representatives(empty).count() == 0
    one = {r.doc_id: r.class_id for r in near_dedup.classes(docs.where("doc_id in (0, 2, 3)")).collect()}
    assert one == {0: 0, 2: 2, 3: 3}
    many = docs.where("doc_id is not null").unionByName(docs.where("doc_id is not null")).repartition(8)  # repeated rows in several tasks
    assert sorted(r.doc_id for r in near_dedup.representatives(many).collect()) == [0, 1, 3, 4]


def test_sharding(spark, odd, empty):
    found = sharding.shard(odd, 4, cell_groups=3, chunk_rows=2).collect()
    assert len(found) == odd.count()
    for s in range(4):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id in (0, 1)}) == 1
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (i * i % 997)) for i in range(3000)], "doc_id long, text string")
    for cell, most in ((10_000, 20), (200, 1_010)):  # one cell; cells of few groups a shard: within the largest group
        sums = Counter()
        for r in sharding.shard(docs, 24, cell_groups=cell).collect():
            sums[r.shard] += r.size
        assert max(sums.values()) - min(sums.values()) <= most
    assert sharding.shard(empty).count() == 0
    many = spark.createDataFrame([(None, "same")] * 50 + [(1, "same")] * 23 + [(2, "x" * 30), (3, None), (3, "")], "doc_id long, text string")
    found = sharding.shard(many, 2, run_rows=7).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter({(None, 12): 50, (1, 12): 23, (2, 38): 1, (3, 8): 2})
    for s in range(2):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))


def test_difference():
    """Against differencing written out plainly, and against the best of all partitions."""
    from itertools import product

    rng = random.Random(4)
    for _ in range(30):
        k, sizes = rng.choice([2, 3, 5]), [rng.randint(1, 99) for _ in range(rng.randint(0, 12))]
        start = np.zeros((len(sizes), k))
        start[:, 0] = sizes
        place = sharding.difference(start)[:, 0] if sizes else []
        sums = [sum(z for z, p in zip(sizes, place) if p == j) for j in range(k)]
        left = [([z] + [0] * (k - 1), i) for i, z in enumerate(sizes)]
        made = len(left)
        while len(left) > 1:
            left.sort(key=lambda v: (min(v[0]) - max(v[0]), v[1]))
            (x, _), (y, _) = left.pop(0), left.pop(0)
            left.append(([a + b for a, b in zip(sorted(x, reverse=True), sorted(y))], made))
            made += 1
        assert sorted(sums) == sorted(left[0][0] if left else [0] * k)
        if len(sizes) <= 8 and k == 2:
            best = min(abs(sum(z if p else -z for z, p in zip(sizes, ps))) for ps in product((0, 1), repeat=len(sizes)))
            assert best <= max(sums) - min(sums) <= best + max(sizes, default=0)


def brute_decontamination(docs, items, size=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        for a in range(max(len(w) - size, 0) + 1 if w and item is not None else 0):
            patterns.setdefault(tuple(w[a : a + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for a in range(len(w)):
            for m in {len(p) for p in patterns}:
                if a + m <= len(w) and tuple(w[a : a + m]) in patterns:
                    hit.update(range(a, a + m))
                    found |= patterns[tuple(w[a : a + m])]
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination(spark, odd, empty):
    items = [(1, story(1, 120)), (2, "CC by"), (3, None), (4, "..."), (None, "one"), (2, "cc by"), (5, "alpha beta gamma"), (6, "red green blue")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(70, "alpha beta gamma"), (70, "red green blue"), (None, "alpha beta gamma"), (None, "red green blue"), (None, "red green blue"), (71, "red x green"), (71, "alpha beta gamma and red green blue")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, 0.5, 7, "clash") for i, t in more], SCHEMA)).where("text is null or length(text) < 100000")
    few = [x for x in items if x[0] != 1]
    for part, items in ((1 << 20, items), (3000, items), (10, few)):
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = brute_decontamination([(r.doc_id, r.text) for r in docs.collect()], items)
        found = [(r.doc_id, r.n_words, r.hits, sorted(r.items)) for r in decontamination.find(docs, bench, part_bytes=part).collect()]
        assert sorted(found, key=repr) == want
        left = decontamination.clean(docs, bench, part_bytes=part)
        assert left.columns == docs.columns and sorted(((r.doc_id, len(words(r.text))) for r in left.collect()), key=repr) == sorted(((i, n) for i, n, hit, _ in want if not hit), key=repr)
        assert decontamination.find(empty, bench, part_bytes=part).count() == 0 and decontamination.clean(empty, bench, part_bytes=part).count() == 0
    assert decontamination.find(odd, bench.limit(0)).where("size(hits) > 0").count() == 0


def near_lines(a, b, least):
    if min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def test_line_dedup(spark, odd, empty):
    rng = random.Random(3)
    pool = [story(s, rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 31, 32, 40])).split(" ") for s in range(30)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice([[], ["new"], [f"n{rng.random()}"]])
                w = w or ["x"]
            lines.append(rng.choice(["", " "]) + rng.choice([" ", "  "]).join(w))
        texts.append("\n".join(lines))
    texts += ["\n".join(["a b c", "a b d", "a b", "x", "a b c d e f g", "a b c d e f g h", "a X c d e f g"]), "common line of words that stands in all texts"] * 2
    texts += ["\n".join(["a a b c d e f g h", "a b c d e f g h", "a a a b c d e f g h", "x a b c d e f g h", "a b c d e f g h h", "a b c d e f g X h h", "a a b c d e f g Y"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (line_dedup.MIN_WORDS, 2):
        kept, seen = [], []
        for t in texts:
            out = []
            for line in t.split("\n"):
                w = line.split()
                if not any(w == s or near_lines(w, s, least) for s in seen):
                    out.append(line)
                seen.append(w)
            kept.append("\n".join(out))
        first = {}
        for k, t in enumerate(texts):
            for line in t.split("\n"):
                first.setdefault(tuple(line.split()), k)
        links = [0] * len(texts)
        for a, k in first.items():
            links[k] += sum(a != b and near_lines(list(a), list(b), least) for b in first if a and b)
        found = line_dedup.deduplicated(docs, least).collect()
        assert {r.doc_id: r.text for r in found} == dict(enumerate(kept))
        assert {r.doc_id: r.n_links for r in found} == dict(enumerate(links)) and sum(links) > 0
    clash = docs.where("doc_id < 3").select("*", *(F.lit("mine").alias(c) for c in ("gone", "g_id", "_t", "t", "n_lines", "links")))
    assert {r.gone for r in line_dedup.deduplicated(clash).collect()} == {"mine"} and {r.n_lines for r in line_dedup.clean(clash).collect()} == {"mine"}
    nobody = spark.createDataFrame([(None, "one line of words\ntwo line of words"), (None, "two line of words"), (None, "two line of words"), (1, "two line of words\nthree")], "doc_id long, text string")
    left = [r.text for r in line_dedup.deduplicated(nobody).collect()]
    assert sorted(left) in (sorted(["one line of words", "two line of words", "two line of words", "three"]), sorted(["one line of words\ntwo line of words", "", "", "three"]))
    found = line_dedup.deduplicated(odd)
    assert set(odd.columns) <= set(found.columns)
    by_id = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert by_id[3].text is None and by_id[4].text == "" and by_id[1].text == "" and by_id[8].text == "line a b c d e f g h\n" and by_id[8].n_near == 1
    assert line_dedup.deduplicated(empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:250] = x[50]
    rows = [(i, [float(v) for v in x[i]], "q") for i in range(600)] + [(1000, None, "q"), (1050, [0.0] * 8, "q"), (1100, [float("nan")] * 8, "q"), (1150, [1.0], "q"), (None, [1.0] * 8, "q"), (100, [float(v) for v in x[100]], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    exact = neighbours.Settings(part_rows=100, mass=1.1, block_rows=64, query_rows=3)
    divided = neighbours.Settings(part_rows=40, most_parts=4, mass=1.1)
    for s in (neighbours.Settings(), exact, divided):
        got = {}
        for r in neighbours.search(df, F.col("vec_id") % 50 == 0, 5, s).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert set(got) == set(range(0, 600, 50))
        hits = 0
        for q, found in got.items():
            score = np.round(u @ u[q], 12)
            score[q] = -9
            want = np.lexsort((np.arange(600), -score))[:5].tolist()
            assert sorted(found) == [1, 2, 3, 4, 5]
            hits += len(set(want) & set(found.values()))
        assert hits == 60 if s.mass > 1 else hits >= 54, (s, hits)
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(df.where("vec_id < 3"), F.lit(True)).count() == 6


def test_pieces(spark, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for r in pieces.tokens(odd).collect():
        ids = lib.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    model = pieces.Pieces(pieces.model_path())
    for text in ["  a", "a  b ", "\t x", "\x00a", "▁a▁", "<s></s>", "a,b.c'd", "ab" * 500, " " * 99, "\U0001F916é é", "<0x0A>"]:
        assert model.encode(text)[0] == lib.encode(text), text
        assert model.numbers(model.long("▁" + text.replace(" ", "▁")))[: 10**6] == lib.encode(text) or "\n" in text
    assert pieces.tokens(empty).count() == 0


def test_a_model_of_another_kind_is_refused(monkeypatch):
    """A vocabulary whose library merges in another way than the agenda does."""
    monkeypatch.setattr(pieces.Pieces, "merge", lambda self, word: [self.id.get(c, self.unknown) for c in word])
    with pytest.raises(ValueError, match="no plain merge-type model"):
        pieces.Pieces(pieces.model_path())


def test_every_row_is_checked_with_the_library(spark, tmp_path):
    """A piece of the user that the texts tried at reading do not show, in rows that are not the first of their slice."""
    import sentencepiece
    import struct

    piece = b"zqx"
    path = str(tmp_path / "user.model")
    with open(pieces.model_path(), "rb") as plain, open(path, "wb") as made:
        inner = b"\x0a" + bytes([len(piece)]) + piece + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x04"
        made.write(plain.read() + b"\x0a" + bytes([len(inner)]) + inner)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.Pieces(path)
    for text in ["a zqx b", "first\nzqx", "x" * 99 + "zqx", "a zqx b"]:  # after a refusal nothing wrong is in the table
        assert lib.get_piece_size() - 1 in lib.encode(text)
        with pytest.raises(ValueError, match="no plain merge-type model"):
            model.encode(text)
    for text in ["a b", "first\nz q x", "it's, \n\n  well"]:
        assert model.encode(text)[0] == lib.encode(text)
    for at in (0, 1, 70):
        rows = spark.createDataFrame([(i, "a zqx b" if i == at else "plain text") for i in range(72)], "doc_id long, text string").coalesce(1)
        with pytest.raises(Exception, match="no plain merge-type model"):
            pieces.tokens(rows, path).collect()


def test_texts_that_the_library_normalises_are_refused():
    model = pieces.Pieces(pieces.model_path())

    class Other:
        def normalize(self, text):
            return model_library.normalize(text).replace("ﬁ", "fi")

    model_library, model.library = model.library, Other()
    with pytest.raises(ValueError, match="no plain merge-type model"):
        model.encode("ﬁn")


PAGE = """<html><head><title>t</title><script>"</p>"</script></head><body><header>Top</header><nav><a>Menu</a></nav>
<div class="post"><h1>Title %d</h1><p>Body &amp; <b>text</b> %d<br>more<p>Second %d</div><div class="legal">Same on all pages</div>
<section id="comments">Nice!</section><form>Name</form><footer>&copy; us</footer></body>"""


def test_html(spark):
    pages = [(i, f"http://h.org/{i}", PAGE % (i, i, i), "clash") for i in range(6)]
    pages += [(10, None, None, ""), (11, "odd url", "", ""), (12, "http://x.org", "<article><p>A<div class=ad>buy</div>b</article> out", ""), (13, "http://x.org", "plain &lt; text <unclosed", ""), (0, "http://h.org/0", PAGE % (0, 0, 0), ""), (14, "http://deep.org", "<div>" * 3000 + "deep", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    assert got[3] == "Title 3\nBody & text 3 more\nSecond 3"
    assert got[10] == "" and got[11] == "" and got[12] == "A\nb" and got[13].startswith("plain < text") and got[14] == "deep"
    assert html_text.extracted(df.limit(0)).count() == 0
    plain = PAGE.replace('class="post"', "").replace('<section id="comments">Nice!</section>', "")
    same = spark.createDataFrame([(i, "http://k.org/", plain % (i, i, i)) for i in range(5)], "page_id long, url string, html string")
    assert html_text.extracted(same).first().text.endswith("Second 0") or "Same on all pages" not in html_text.extracted(same).first().text


def brute_matching(a, b):
    """The most nodes that any order-keeping alignment of two trees matches, over all alignments."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute_matching(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[html_text.BELOW], b[html_text.BELOW])


def test_tree_matching():
    rng = random.Random(1)

    def grown(depth):
        return [rng.choice("abc"), 1, 0, 0, 0, 0, 1, 1, [grown(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []]

    for _ in range(400):
        a, b = grown(3), grown(3)
        a[0] = b[0] = "r"
        assert html_text.matching(a, b) == brute_matching(a, b)
        both = html_text.merged(a, b)
        count = lambda t: 1 + sum(map(count, t[html_text.BELOW]))
        assert count(both) == count(a) + count(b) - brute_matching(a, b) or count(both) >= max(count(a), count(b))


def wrapped(sources):
    """The texts of pages of one host, with and without the lists of tags and names."""
    whole = html_text.Wrapper()
    for source in sources:
        whole.add(html_text.tree(html_text.Page(source)))
    found = html_text.wrapper_of(whole.tree)
    return [html_text.Page(s).text(found) for s in sources], [html_text.Page(s).text(found, lists=False) for s in sources]


def test_wrappers():
    def page(i, main):
        menu = "".join(f"<li><a href=x>{story(100 * i + k, 1)}</a></li>" for k in range(5))
        return f'<html><body class="page-{i} x{i}"><div class="top"><ul>{menu}</ul></div><div class="box one">{story(500 + i, 4)}</div>{main}<div class="end">{story(900 + i, 5)} c</div></body></html>'

    def paragraphs(i):
        return "".join(f"<p>{story(1000 * i + k, 20)}</p>" for k in range(2 + i % 4))

    def said(i):
        return "\n".join(story(1000 * i + k, 20) for k in range(2 + i % 4))

    for main, want in (
        (lambda i: f'<div class="c" id="post-{i}"><h1>Head {i}</h1>{paragraphs(i)}</div>', lambda i: f"Head {i}\n{said(i)}"),  # no tag, name or constant text helps
        (lambda i: f"<main><header><h2>Head {i}</h2></header><article>{paragraphs(i)}</article></main>", lambda i: f"Head {i}\n{said(i)}"),
        (lambda i: f"<article>{paragraphs(i)}</article><article><p>Second {i}</p></article>", lambda i: f"{said(i)}\nSecond {i}"),
        (lambda i: f"<article><div class='social history'>Rome {i}</div>{paragraphs(i)}<p class=legal>Same on all</p></article>", lambda i: f"Rome {i}\n{said(i)}"),
    ):
        both = wrapped([page(i, main(i)) for i in range(8)])
        for texts in both:
            assert texts == [want(i) for i in range(8)]
    few = [html_text.Page(page(i, f"<article>{paragraphs(i)}</article><article>B{i}</article>")).text(None) for i in range(2)]
    assert few == [f"{said(i)}\nB{i}" for i in range(2)]
    assert html_text.Page('<div class="content">A</div><div class="content">B</div><nav>C</nav>').text(None) == "A\nB"
    assert html_text.Page("").text(None) == "" and html_text.wrapper_of(html_text.tree(html_text.Page(""))) is None


def test_html_time():
    import time

    for source in ("<a" * 100_000, "<div>" * 20_000 + "deep", "<![CDATA[" * 50_000, "<!" * 50_000, '<a ="' * 50_000, "<p><button>" + "<div>" * 20_000, "<a x='" + "<b>" * 50_000, "".join(f"<div class=c{'x' * (k % 300)}>" "</div>" for k in range(5000))):
        began = time.time()
        page = html_text.Page(source)
        page.text(html_text.wrapper_of(html_text.merged(html_text.tree(page), html_text.tree(page))))
        assert time.time() - began < 3


def test_repeats(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 100_000]
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for (doc_id, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    small = odd.where("text is null or length(text) < 100000")
    for group in (20_000, 1):
        spans = repeats.GROUP
        repeats.repeated.__defaults__ = (*repeats.repeated.__defaults__[:2], group, repeats.repeated.__defaults__[3])
        got = [tuple(r) for r in repeats.removed(small).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert spans == repeats.GROUP
    assert {r.doc_id: r.n_removed for r in repeats.removed(odd.where("doc_id = 9")).collect()} == {9: 300_000}
    part = story(77, 200)[:700]
    at = repeats.PIECE - 350  # over the end of the first piece of a text of more than 4 MB
    noise = "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz", k=repeats.PIECE + 5000))
    long = spark.createDataFrame([(1, noise[:at] + part + noise[at:]), (2, f"short {part} end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.removed(long).collect()}
    assert got == {1: (700, 1), 2: (700, 1)}
    assert repeats.removed(empty).count() == 0


def test_doubling():
    rng = np.random.default_rng(2)
    for length, seed in ((200, 40), (50, 10), (33, 8), (16, 16)):
        base = rng.integers(0, 2, 3000).astype(np.uint8)
        flat = np.concatenate([base, base[100:400], rng.integers(0, 2, 500).astype(np.uint8), base[1000 : 1000 + length - 1], base[2000 : 2000 + length]])
        at = rng.permutation(len(flat) - length + 1)[:2500]
        seen = Counter(flat[i : i + length].tobytes() for i in at.tolist())
        assert repeats.doubled(flat, at, length, seed).tolist() == [seen[flat[i : i + length].tobytes()] > 1 for i in at.tolist()]


def test_licenses(spark, odd, empty):
    got = {r.doc_id: r for r in licenses.scan(odd, ["doc_id"]).collect() if r.doc_id is not None}
    assert (got[7].n_words, got[7].n_base, got[7].first_word, got[7].last_word, got[7].base) == (7, 3, 0, 5, ["cc-by", "reserved"])
    assert got[3].n_words == 0 and got[4].n_base == 0 and got[4].first_word is None
    assert len(licenses.RULES) > 200 and licenses.scan(empty).count() == 0
    text = spark.createDataFrame([(1, "Licensed under the GNU Lesser General Public License, version 2.1.")], "doc_id long, text string")
    assert {licenses.RULES[i].label for i in licenses.scan(text).first().found} == {"lgpl"}


def test_licenses_brute(spark):
    import time

    rng = random.Random(9)
    parts = ["Licensed under the Apache License, version 2.0", "GNU General Public License v3 or any later", "CC BY-SA 4.0", "all rights reserved", "public domain", "MIT License", "SPDX-License-Identifier: GPL-2.0", "foo bar", "the software shall be used for good, not evil", "copyright (c) 2019", "under the terms of the", "Mozilla Public License", "no rights reserved"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, _s string, found string, n_words int")
    for r in licenses.scan(docs).collect():
        spaced = "".join(f" {w} " for w in words(texts[r.doc_id]))
        every = [(m.start(), m.end(), rule.priority, i) for i, rule in enumerate(licenses.RULES) if rule.needs in spaced for m in re.finditer(rule.pattern, spaced)]
        want = sorted(x[3] for x in every if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or (y[2] == x[2] and y[3] < x[3])) for y in every))
        assert sorted(r.found) == want and r._s == "a" and r.n_words == len(words(texts[r.doc_id]))
    long = spark.createDataFrame([(1, "Licensed under the Apache License, version 2.0. " * 9600)], "doc_id long, text string")
    began = time.time()
    assert len(licenses.scan(long).first().found) == 9600
    assert time.time() - began < 15


def plain_ftrl(rows, s):
    """FTRL-proximal one coordinate at a time."""
    import math

    z, n = {}, {}

    def weight(k, l1):
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else (math.copysign(l1, zk) - zk) / ((s.beta + math.sqrt(n.get(k, 0.0))) / s.alpha + (s.l2 if k >= 0 else 0.0))

    for _ in range(s.epochs):
        for at, label in rows:
            w = {k: weight(k, s.l1 if k >= 0 else 0.0) for k in (-1, *at)}
            g = (1 / (1 + math.exp(-min(35.0, max(-35.0, sum(w.values()))))) - label) * (s.positive_weight if label else 1.0)
            for k in w:
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / s.alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k, s.l1 if k >= 0 else 0.0) for k in z}


def sets_of(texts, bits=20):
    import pyarrow as pa

    from proselens.llm import wordscan

    out = []
    for t in texts:
        _, at = toxicity.coordinates(wordscan.scan(pa.array([t or ""])), bits)
        out.append(sorted(set(at.tolist())))
    return out


def test_ftrl():
    rng = random.Random(6)
    rows = [(sorted(rng.sample(range(60), rng.randint(0, 9)) + [100 + i % 2]), i % 2) for i in range(80)]
    for s in (toxicity.Settings(l1=0.3), toxicity.Settings(l1=2.0, epochs=2, positive_weight=1.0)):
        intercept, at, weights = toxicity.ftrl([(np.array(a, np.int32), label) for a, label in rows], s)
        want = plain_ftrl(rows, s)
        assert abs(intercept - want[-1]) < 1e-9
        assert {k: w for k, w in want.items() if k >= 0 and w} == pytest.approx(dict(zip(at.tolist(), weights.tolist())))


def test_pipeline_end_to_end(spark):
    """All five stages written out plainly over a whole table."""
    import math
    import zlib

    import corpus_pipeline
    import sentencepiece

    from proselens.llm import wordscan

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    s = toxicity.Settings()
    known = sorted(((wordscan.mix(np.array([hash(i) & (2**64 - 1)], np.uint64))[0], i, t) for i, t in docs if i in labels), key=lambda x: x[:2])
    weights = plain_ftrl(list(zip(sets_of(t for _, _, t in known), (labels[i] for _, i, _ in known))), s)
    docs = [(i, t) for (i, t), at in zip(docs, sets_of(t for _, t in docs)) if 1 / (1 + math.exp(-sum(weights.get(k, 0.0) for k in (-1, *at)))) < 0.5]
    seen, by_length, left = set(), {}, []
    for i, t in docs:
        kept = []
        for line in (t or "").split("\n"):
            w = tuple(line.split())
            if not w or not (w in seen or any(near_lines(w, x, line_dedup.MIN_WORDS) for n in (-1, 0, 1) for x in by_length.get(len(w) + n, ()))):
                kept.append(line)
            if w and w not in seen:
                seen.add(w)
                by_length.setdefault(len(w), []).append(w)
        if any(x.split() for x in kept) or not (t or "").split():
            left.append((i, "\n".join(kept)))
    sets, up = [shingles(t) for _, t in left], list(range(len(left)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a].keys() & sets[b].keys()) * 2 > min(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= 0.8 or not sets[a] and not sets[b] and left[a][1] == left[b][1]:
                up[max(root(a), root(b))] = min(root(a), root(b))
    left = [x for k, x in enumerate(left) if root(k) == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, _, h, _ in brute_decontamination(left, items) if h}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = {i: (t, lib.encode(t)) for i, t in left if i not in hit}
    got = {r.doc_id: (r.text or "", r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gone array<int>, k string, _one string, n_lines long"


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    base, other = story(11, 80), story(12, 80)
    rows = [(1, base), (1, other), (1, base), (2, base + " x"), (None, base), (None, base), (3, None), (4, ""), (5, ""), (6, "solo"), (7, story(13, 30_000)), (8, base + "\n" + other)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), 0.3, [1], "k", "o", 5) for i, t in rows], STAGE_SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf)
            found = out.collect()
            assert len(found) <= given.count()
            if name != "pieces":
                assert out.columns == docs.columns
                assert all((r.score, r.gone, r.k, r._one, r.n_lines) == (0.3, [1], "k", "o", 5) for r in found)
    near = corpus_pipeline.near_deduplication(spark, docs, sf).collect()
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in near if r.doc_id is not None) == sorted([(1, base[:5]), (1, other[:5]), (3, ""), (6, "solo"), (7, rows[10][1][:5]), (8, base[:5])])
    assert sum(r.doc_id is None for r in near) == 2


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "pieces"]
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(docs.columns) < set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) <= docs.count()
    found = decontamination.find(out, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert found.where("size(hits) > 0").count() == 0


def test_contradicting_labels(spark):
    """Of contradicting labels of one document 1 counts, and rows that repeat a document count once."""
    docs = spark.createDataFrame([(i, story(i, 30) + (" vile" if i % 3 == 0 else "")) for i in range(60)], "doc_id long, text string")
    plain = [(i, int(i % 3 == 0)) for i in range(60)]
    s = toxicity.Settings(l1=0.5)
    one, other = (toxicity.train(d, spark.createDataFrame(rows, "doc_id long, toxic int"), s) for d, rows in ((docs, plain), (docs.unionByName(docs), [*plain, *((i, 0) for i in range(60)), (3, None), (4, 7)])))
    assert one.intercept == other.intercept and one.index.tolist() == other.index.tolist() and one.weight.tolist() == other.weight.tolist() and len(one.index)


def test_shared_folder_and_names(spark):
    from types import SimpleNamespace

    from proselens.llm import common

    class Unset:
        def get(self, name, default=None):
            return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=Unset(), sparkContext=SimpleNamespace(master="yarn")))
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common.fresh(spark.createDataFrame([(1, 2)], "k int, _K int"), "k", "k", "own") == ["__k", "___k", "own"]
