"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ``size`` consecutive words of a benchmark item, or all words of a shorter item.  Patterns of
one length make one searcher, with words as the alphabet:

* the shift table gives for each block of two words (one, for one-word patterns) how far a search may skip: the
  distance from the block's last occurrence in any pattern to the pattern's end, or the whole length for other blocks;
* where the shift is 0, the hash of the whole suffix selects the bucket of patterns that can end here;
* the words themselves are then compared, so a hash never decides.

The windows are a table, made on the executors and dealt by hash into parts of at most ``part_bytes``; a window with its
item is one row, so no item and no window can make a part larger.  The driver hands on one part at a time, and each
executor builds the searchers from it.  Each part is one pass over the documents, without a shuffle; with several
parts the hits are joined by the hash of the text, on which alone they depend.

Defined cases: null texts have no words; items without words have no windows; items of the same id count as one; a
null item_id takes no part; repeated documents are searched each, and rows of one doc_id, or of none, by their own
texts; other columns are not looked at (``clean`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordscan
from .common import cut, fresh, table

WINDOW = 10
PART_BYTES = 16 << 20


class Searcher:
    """Wu-Manber over word numbers, for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[int]], vocabulary: int):
        self.length, self.block = length, min(2, length)
        self.base = vocabulary + 1
        shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], list[int]]]] = defaultdict(list)
        for words, items in patterns.items():
            for j in range(self.block - 1, length):
                key = self.key(words[j - self.block + 1 : j + 1])
                shift[key] = min(shift.get(key, length), length - 1 - j)
            self.buckets[hash(words)].append((words, items))
        self.keys = np.array(sorted(shift), np.int64)
        self.shifts = np.array([shift[k] for k in sorted(shift)], np.int64)
        self.other = length - self.block + 1

    def key(self, block: tuple[int, ...]) -> int:
        return block[0] if self.block == 1 else block[0] * self.base + block[1]

    def table(self, ids: np.ndarray) -> np.ndarray:
        """The shift at each word of a run of texts, for the block that ends there."""
        key = ids.copy()
        if self.block == 2:
            key[1:] += ids[:-1] * self.base
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.shifts[at], self.other)

    def search(self, words: list[int], shifts: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence in one text."""
        at, m = self.length - 1, self.length
        while at < len(words):
            skip = shifts[at]
            if skip:
                at += skip
                continue
            text = tuple(words[at - m + 1 : at + 1])
            for pattern, items in self.buckets.get(hash(text), ()):
                if pattern == text:
                    yield at - m + 1, items
            at += 1


class Patterns:
    """The windows of one part: the words' numbers, and a searcher for each length of window."""

    def __init__(self, windows: list[str], items: list[str]):
        self.items = sorted(set(items))
        place = {item: k for k, item in enumerate(self.items)}
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for window, item in zip(windows, items, strict=True):
            words = tuple(self.number.setdefault(w.encode(), len(self.number) + 1) for w in window.split(" "))
            found[len(words)][words].append(place[item])
        hashes: dict[int, list[bytes]] = defaultdict(list)
        for w, h in zip(self.number, wordscan.scan(pa.array([w.decode() for w in self.number], pa.string())).hash.tolist(), strict=True):
            hashes[h].append(w)
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.ids = np.array([self.number[hashes[h][0]] if len(hashes[h]) == 1 else -1 for h in sorted(hashes)], np.int64)
        self.searchers = [Searcher(m, dict(w), len(self.number)) for m, w in sorted(found.items())]

    def numbers(self, words: wordscan.Words) -> np.ndarray:
        """The number of each word, 0 for words of no pattern; a word that hashes as a pattern's is compared with it."""
        if not len(self.hashes):
            return np.zeros(len(words.hash), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == words.hash, self.ids[at], 0)
        for i in np.flatnonzero(out).tolist():
            out[i] = self.number.get(words.flat[words.start[i] : words.end[i]].tobytes(), 0)
        return out


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window string, item string) of all items of ``benchmark`` (item_id, text), each pair once; words with a blank between."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                words = wordscan.scan(part.column("text"))
                flat, ends = words.flat.tobytes(), np.concatenate([[0], np.cumsum(words.counts)])
                found, rows = [], []
                for i in range(part.num_rows):
                    own = [flat[a:b].decode() for a, b in zip(words.start[ends[i] : ends[i + 1]], words.end[ends[i] : ends[i + 1]], strict=True)]
                    found += [" ".join(own[a : a + size]) for a in range(max(len(own) - size, 0) + 1)] if own else []
                    rows += [i] * (len(found) - len(rows))
                yield pa.record_batch([pa.array(found, pa.string()), part.column("item").take(pa.array(rows, pa.int64()))], ["window", "item"])

    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(work, "window string, item string").distinct()


def parts(benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, bytes]]:
    """(how many parts, one part as Arrow bytes), part after part; a benchmark without windows is one empty part."""
    held = cut(windows(benchmark, size), "windows")
    total = held.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // part_bytes))
    for i in range(n):
        t = held.where(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == i).toArrow().sort_by([("window", "ascending"), ("item", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as stream:
            stream.write_table(t)
        yield n, sink.getvalue().to_pybytes()


_built: dict[bytes, Patterns] = {}


def built(blob: bytes) -> Patterns:
    """The searchers of a part; a worker keeps those of the last one."""
    key = hashlib.md5(blob).digest()
    if key not in _built:
        _built.clear()
        t = pa.ipc.open_stream(blob).read_all()
        _built[key] = Patterns(t["window"].to_pylist(), t["item"].to_pylist())
    return _built[key]


def _key(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _hits_by_text(docs: DataFrame, blobs: Iterator[bytes]) -> DataFrame:
    """(k binary, hits, items) of the distinct texts of ``docs`` in which any of the parts occurs."""
    passes = []
    for blob in blobs:

        def work(batches: Iterator[pa.RecordBatch], blob: bytes = blob) -> Iterator[pa.RecordBatch]:
            patterns = built(blob)
            for batch in batches:
                for part in wordscan.slices(batch, "text"):
                    for found in hits(part, patterns):
                        yield found.select(["k", "hits", "items"]).take(pa.array(np.flatnonzero(found.column("hits").value_lengths().to_numpy())))

        found = docs.select(_key("text").alias("k"), "text").mapInArrow(work, "k binary, hits array<int>, items array<string>")
        passes.append(cut(found.groupBy("k").agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits"))
    whole = passes[0]
    for other in passes[1:]:
        whole = whole.unionByName(other)

    def joined(name: str) -> F.Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

    return cut(whole.groupBy("k").agg(joined("hits"), joined("items")), "hits")


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_words, hits array<int> (numbers of hit words) and items array<string>."""
    made = parts(benchmark, size, part_bytes)
    n, first = next(made)
    kind = docs.schema["doc_id"]
    schema = T.StructType([kind, *T._parse_datatype_string("n_words bigint, hits array<int>, items array<string>").fields])
    if n == 1:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = built(first)
            for batch in batches:
                for part in wordscan.slices(batch, "text"):
                    yield from hits(part, patterns)

        return docs.select("doc_id", "text").mapInArrow(work, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), part.column("k"), pa.array(wordscan.scan(part.column("text")).counts, pa.int64())], ["doc_id", "k", "n_words"])

    found = _hits_by_text(docs, _chained(first, made))
    counted = docs.select("doc_id", _key("text").alias("k"), "text").mapInArrow(count, T.StructType([kind, *T._parse_datatype_string("k binary, n_words bigint").fields]))
    return counted.join(found, "k", "left").select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<int>"), ("items", "array<string>"))))


def _chained(first: bytes, rest: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
    yield first
    for _, blob in rest:
        yield blob


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) in whose text no window of ``benchmark`` stands."""
    made = parts(benchmark, size, part_bytes)
    n, first = next(made)
    if n == 1:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = built(first)
            for batch in batches:
                for part in wordscan.slices(batch, "text"):
                    for found in hits(part, patterns):
                        yield part.take(pa.array(np.flatnonzero(found.column("hits").value_lengths().to_numpy() == 0)))

        return docs.mapInArrow(work, docs.schema)
    (k,) = fresh(docs, "k")
    found = _hits_by_text(docs, _chained(first, made)).select(F.col("k").alias(k))
    return docs.withColumn(k, _key("text")).join(found, k, "left_anti").select(*docs.columns)


def hits(part: pa.RecordBatch, patterns: Patterns) -> Iterator[pa.RecordBatch]:
    """The rows' own keys (doc_id or k), n_words, hits and items."""
    words = wordscan.scan(part.column("text"))
    ids, counts = patterns.numbers(words), words.counts
    ends = np.concatenate([[0], np.cumsum(counts)])
    found: list[tuple[list[int], list[str]]] = [([], []) for _ in range(part.num_rows)]
    tables = [s.table(ids) if len(ids) else ids for s in patterns.searchers]
    known = np.add.reduceat(np.append(ids != 0, False), np.minimum(ends[:-1], len(ids))) if part.num_rows else ends[:0]
    for i in np.flatnonzero((known > 0) & (counts > 0)).tolist():
        a, b = int(ends[i]), int(ends[i + 1])
        own, covered, items = ids[a:b].tolist(), set(), set()
        for searcher, shifts in zip(patterns.searchers, tables, strict=True):
            if searcher.length <= b - a:
                for first, which in searcher.search(own, shifts[a:b].tolist()):
                    covered.update(range(first, first + searcher.length))
                    items.update(which)
        found[i] = (sorted(covered), sorted(patterns.items[k] for k in items))
    own = [c for c in ("doc_id", "k") if c in part.schema.names][:1]
    yield pa.record_batch([part.column(own[0]), pa.array(counts, pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.string()))], [own[0], "n_words", "hits", "items"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each of ``documents`` stands in windows of ``benchmark``."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, w, least({WINDOW}, len(w)) as m from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0 and item_id is not null),
p as (select distinct item_id, m, array_to_string(w[a:a + m - 1], ' ') as s from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as a from b)),
l as (select distinct m from p),
q as (select doc_id, m, a, array_to_string(w[a:a + m - 1], ' ') as s
      from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as a from d, l where len(w) >= m)),
h as (select q.doc_id, q.a, q.m, p.item_id from q join p on q.m = p.m and q.s = p.s),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(a, a + m)) as x from (select distinct doc_id, a, m from h)) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
       sha256(coalesce(i.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
