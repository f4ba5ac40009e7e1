"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text is the multiset of its five-word shingles (a text of fewer words, but not none, is one shingle), and two texts
are near when their probability Jaccard is 0.8 or more; for texts that repeat no shingle that is the Jaccard index.

1. Signatures: in one pass each text gets its ProbMinHash registers.  Elements arrive at registers in Poisson
   processes whose rate is the shingle's weight, and a process is ended as soon as it can win no register.
2. Equal texts become one, by hash, before anything else; from here on there are distinct texts only, by number.
3. Banding: ``BANDS`` bands of ``ROWS`` registers are bucket keys; texts of 0.8 share none with probability 3e-6.
4. Pivots: in each bucket the text that meets most others over all its buckets is the pivot, and the others are
   compared with it, never with each other.  In a group of copies of one original the pivot is the original or one
   like it, so one comparison a copy links the group.  Links give components.
5. The rest: only buckets that still hold several components go on, and in them only texts that can have a link at
   all: shingles that stand in no other of these texts are a share of the text that bounds its similarity with every
   other text.  A share over 0.2 rules out all links, and two shares over 1/9 each rule out a link of the two, so texts
   between the bounds meet only texts below.  In each bucket its largest component is the side that others are compared
   with, so a group of copies is not compared within itself.  What a last bound leaves (for a pair, the bits that one
   text's sketch has and the other's has not; each pair in the first band it shares) is compared exactly.  So no link
   within a bucket is lost, and no group of copies is expanded into its pairs.
6. Components of all links are the classes; the class id is the smallest doc_id.

Hot groups: minima, counts and sums are combined before the shuffle; the joins are equi-joins on bucket, text or id
that are divided when skewed.  Sides are broadcast only after their rows have been counted.

Defined cases: a null text counts as empty; texts without words have no signature and are in a class with equal texts
only; rows of one doc_id with different texts are in the classes of their texts; a row without doc_id has no class
(null); ties go to the smaller doc_id; other columns are not looked at (``representatives`` keeps them); an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan
from .common import cut, drop, fresh, small, table
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
SKETCH_LONGS = 16


def weighted(words: wordscan.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles of a run of texts; the weight is the count."""
    text, h = wordscan.shingles(words, size)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of n weighted sets: the element that arrives first at each register (0: an empty set).

    Each element arrives at random registers in a Poisson process of its weight; its arrivals are a function of the
    element alone, so that a weight only stretches time.  A register keeps its first arrival, and an element's process
    ends as soon as it is past the latest first arrival of its set: whatever came later could change nothing.
    """
    time = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    at = np.zeros(len(element))
    left, drawn = np.arange(len(element)), 0
    while len(left):
        e, w, t = element[left], weight[left], text[left]
        now = at[left]
        for _ in range(1 if drawn < 4 else 16):
            drawn += 1
            bits = wordscan.mix(e + np.uint64((drawn * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            now = now - np.log(u) / w
            slot = t * registers + (wordscan.mix(bits ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(time, slot, now)
            won = time[slot] == now
            winner[slot[won]] = e[won]
        at[left] = now
        left = left[now < time.reshape(n, registers).max(1)[t]]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key a band; the band's number is part of it."""
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(signature), 0)
    for r in range(rows):
        keys = wordscan.mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature.reshape(-1, bands, rows)[:, :, r])
    return keys.view(np.int64)


def probability_jaccard(hx: np.ndarray, wx: np.ndarray | None, hy: np.ndarray, wy: np.ndarray | None) -> float:
    """The probability Jaccard of two multisets of sorted distinct hashes; no weights: all are 1."""
    at = np.minimum(np.searchsorted(hx, hy), max(len(hx) - 1, 0))
    both = hx[at] == hy if len(hx) and len(hy) else np.zeros(len(hy), bool)
    if wx is None and wy is None:
        n = int(both.sum())
        return n / (len(hx) + len(hy) - n) if n else 0.0
    wx = np.ones(len(hx)) if wx is None else wx
    wy = np.ones(len(hy)) if wy is None else wy
    x, y = wx[at[both]], wy[both]
    order = np.argsort(y / x)
    x, y = x[order], y[order]
    upto = np.cumsum(x) + (wx.sum() - x.sum())
    after = y.sum() - np.cumsum(y) + (wy.sum() - y.sum())
    return float((1 / (upto / x + after / y)).sum())


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k binary, bands array<bigint>) of each row: hash of the text, and its bucket keys (null without words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                flat, ends = wordscan.raw(part.column("text"))
                keys = [hashlib.md5(flat[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                text, h, w = weighted(wordscan.scan(part.column("text")))
                found = band_keys(prob_minhash(text, h, w, part.num_rows, bands * rows), bands, rows)
                empty = np.bincount(text, minlength=part.num_rows) == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * bands, pa.int32()), pa.array(found.ravel()), mask=pa.array(empty))
                yield pa.record_batch([part.column("doc_id"), pa.array(keys, pa.binary()), lists], ["doc_id", "k", "bands"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k binary, bands array<bigint>")


def features(docs: DataFrame) -> DataFrame:
    """(id, h binary, w binary, total double, bits array<bigint>, task int) of rows (id, text): sorted shingle hashes,
    weights unless all are 1, the sum of weights, a sketch in which each shingle sets one bit, and the task that made it.

    Rows that repeat an id come out once a task.
    """

    def sketches(text: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
        bits = np.zeros(n * SKETCH_LONGS, np.uint64)
        at = (h >> np.uint64(20)) % np.uint64(SKETCH_LONGS * 64)
        np.bitwise_or.at(bits, text * SKETCH_LONGS + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SKETCH_LONGS, pa.int32()), pa.array(bits.view(np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), set()
        for batch in batches:
            new = [k for k, i in enumerate(batch.column("id").to_pylist()) if i not in seen and not seen.add(i)]
            for part in wordscan.slices(batch.take(pa.array(new, pa.int64())), "text"):
                text, h, w = weighted(wordscan.scan(part.column("text")))
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                spans = list(zip(ends[:-1], ends[1:], strict=True))
                yield pa.record_batch(
                    [
                        part.column("id"),
                        pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([w[a:b].tobytes() if (w[a:b] != 1).any() else None for a, b in spans], pa.binary()),
                        pa.array([float(w[a:b].sum()) for a, b in spans], pa.float64()),
                        sketches(text, h, part.num_rows),
                        pa.array(np.full(part.num_rows, task), pa.int32()),
                    ],
                    ["id", "h", "w", "total", "bits", "task"],
                )

    return docs.select("id", "text").mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, h binary, w binary, total double, bits array<bigint>, task int")


def linked(pairs: DataFrame, feats: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least that probability Jaccard; ``feats``: a row for each id (broadcast if it is marked so)."""
    side = feats.select("id", "h", "w")
    kind = feats.schema["id"].dataType.simpleString()
    joined = pairs.join(side.toDF("a", "ha", "wa"), "a").join(side.toDF("b", "hb", "wb"), "b")

    def numbers(x: bytes | None, kind: type) -> np.ndarray | None:
        return None if x is None else np.frombuffer(x, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, wa, hb, wb = (batch.column(c) for c in ("ha", "wa", "hb", "wb"))
            good = [
                probability_jaccard(*(numbers(col[i].as_py(), t) for col, t in ((ha, np.uint64), (wa, np.float64), (hb, np.uint64), (wb, np.float64)))) >= similarity
                for i in range(batch.num_rows)
            ]
            at = pa.array(np.flatnonzero(good))
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return joined.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(work, f"a {kind}, b {kind}")


def _alone(feats: DataFrame) -> DataFrame:
    """(id, lone double): the weight of the shingles that no other of these texts has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "h"):
                hs = [np.frombuffer(x, np.int64) for x in part.column("h").to_pylist()]
                ws = [np.ones(len(h)) if w is None else np.frombuffer(w, np.float64) for h, w in zip(hs, part.column("w").to_pylist(), strict=True)]
                rows = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
                if len(rows):
                    yield pa.record_batch([part.column("id").take(pa.array(rows)), pa.array(np.concatenate(hs)), pa.array(np.concatenate(ws))], ["id", "s", "weight"])

    exploded = feats.select("id", "h", "w").mapInArrow(work, f"id {feats.schema['id'].dataType.simpleString()}, s bigint, weight double")
    lone = exploded.groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.sum("weight").alias("weight")).where("n = 1")
    return lone.groupBy("id").agg(F.sum("weight").alias("lone"))


def _bound(a: Column, b: Column) -> Column:
    """The most that the similarity of two texts can be; a, b: structs of total, lone, plain (no weights) and bits.

    What a text has and the other has not weighs ``lone`` at least, and one for each bit of its sketch that the other's
    lacks.  With no weights the rest is the most that both can share; with weights, the shares x and y that are alone
    leave at most 1 / (1 / (1 - x) + y / (1 - y)), by concavity over the terms of the probability Jaccard.
    """

    def alone(x: Column, y: Column) -> Column:
        missing = [F.bit_count(F.get(x["bits"], F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y["bits"], F.lit(i))))) for i in range(SKETCH_LONGS)]
        return F.greatest(x["lone"], sum(missing[1:], missing[0]).cast("double"))

    alone_a, alone_b = alone(a, b), alone(b, a)
    common = F.least(a["total"] - alone_a, b["total"] - alone_b)
    x, y = alone_a / a["total"], alone_b / b["total"]
    general = F.when((x >= 1) | (y >= 1), 0.0).otherwise(F.least(1 / (1 / (1 - x) + y / (1 - y)), 1 / (1 / (1 - y) + x / (1 - x))))
    return F.when(a["plain"] & b["plain"], common / (a["total"] + b["total"] - common)).otherwise(general)


def text_key(text: Column) -> Column:
    """The hash that stands for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _texts(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """(k binary, id, component bigint) of the distinct texts of rows with a doc_id; id: the smallest one of each text."""
    named = docs.where("doc_id is not null").select("doc_id", "text")
    once = signatures(named, bands, rows).groupBy("k").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    texts = cut(once.withColumn("id", F.monotonically_increasing_id()), "texts")
    keys = texts.select("id", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keys.join(sizes, "key"), "met")
    popular = met.groupBy("id").agg(F.sum("n").alias("popular"))
    members = cut(met.join(popular, "id").select("key", "id", "popular"), "members")
    drop(met)
    pivots = members.groupBy("key").agg(F.min_by("id", F.struct(-F.col("popular"), F.col("id"))).alias("pivot"))
    pairs = members.join(pivots, "key").where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()

    # Features of the texts that meet others: each text is read from one of the rows with its smallest doc_id.
    wanted = cut(texts.join(members.select("id").distinct(), "id", "left_semi").select(F.col("least").alias("doc_id"), "k", "id"), "wanted")
    wide = 64 if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") else 1 << 10
    read = named.withColumn("k", text_key(F.col("text"))).join(small(wanted, wide), ["doc_id", "k"]).select("id", "text")
    feats = cut(features(read), "features")
    again = cut(feats.groupBy("id").agg(F.count("*").alias("n"), F.min("task").alias("one")).where("n > 1").select("id", "one"), "again")
    if again.count():  # rows of one id and text in several tasks: the first task's counts
        feats = feats.join(small(again, 64), "id", "left").where("one is null or one = task").drop("one")
    links = cut(linked(pairs, feats, similarity), "links")
    first = cut(components(links), "first")

    # The rest: buckets of several components, the largest of each marked.
    placed = members.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("kinds"))
    placed = cut(placed.join(counted.where("kinds > 1").select("key", "major"), "key"), "placed")
    rest = cut(feats.join(placed.select("id").distinct(), "id", "left_semi"), "rest")
    judged = rest.select("id", "total", F.col("w").isNull().alias("plain"), "bits").join(_alone(rest), "id", "left").select("id", F.struct("total", F.coalesce("lone", F.lit(0.0)).alias("lone"), "plain", "bits").alias("by"))
    share = F.col("by.lone") / F.col("by.total")
    able = judged.where(share <= 1 - similarity + 1e-9).withColumn("apart", share > (1 - similarity) / (1 + similarity) + 1e-9)
    able = cut(placed.join(able, "id").join(texts.select("id", "bands"), "id"), "able")
    a, b = (able.select("key", "major", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "by", "bands", "apart"))) for s in "ab")
    first_shared = F.element_at(F.filter(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1) == F.col("key")
    bounded_pair = (_bound(F.col("by_a"), F.col("by_b")) >= similarity - 1e-9) & first_shared

    def met_by(a: DataFrame, b: DataFrame, once: Column) -> DataFrame:
        return a.join(b.drop("major"), "key").where(once & (F.col("component_a") != F.col("component_b")) & bounded_pair).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    minor_a, is_major_b = a.where("component_a <> major"), F.col("component_b") == F.col("major")
    low, high = minor_a.where("not apart_a"), minor_a.where("apart_a")
    # minor texts below the lower bound meet all others; those above it meet the texts below it in the major component only
    # (their pairs with minor texts below it are among the first)
    more = met_by(low, b, is_major_b | F.col("apart_b") | (F.col("id_a") < F.col("id_b"))).unionByName(met_by(high, b.where("not apart_b"), is_major_b))
    more = cut(more.distinct(), "more")
    drop(placed), drop(able), drop(rest)
    ids = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = cut(feats.select("id", "h", "w").join(ids, "id", "left_semi"), "few")
    held = few.agg(F.coalesce(F.sum(F.octet_length("h") + F.coalesce(F.octet_length("w"), F.lit(0)) + 64), F.lit(0))).first()[0]
    every = cut(links.unionByName(linked(more, F.broadcast(few) if held <= 32 << 20 else few, similarity)), "links")
    drop(feats), drop(members), drop(wanted), drop(first)
    return texts.join(components(every), "id", "left").select("k", F.col("least").alias("id"), F.coalesce("component", "id").alias("component"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, class_id)."""
    texts = cut(_texts(docs, similarity, bands, rows), "classes")
    least = texts.groupBy("component").agg(F.min("id").alias("class_id"))
    named = texts.join(least, "component").select("k", "class_id")
    keyed = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), text_key(F.col("text"))).alias("k"))
    return keyed.join(named, "k", "left").select("doc_id", "class_id")


def representatives(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stay when one row of each class is kept.

    It is the row of smallest doc_id, and of texts with the same doc_id the one of smallest hash; of rows that have both
    in common, the least by all columns.  Rows without doc_id are in no class and all stay.
    """
    texts = cut(_texts(docs, similarity, bands, rows), "classes")
    k, own = fresh(docs, "k", "own")
    best = texts.groupBy("component").agg(F.min(F.struct("id", "k")).alias("best")).select(F.col("best.id").alias(own), F.col("best.k").alias(k))
    named = docs.where("doc_id is not null").withColumn(k, text_key(F.col("text")))
    chosen = named.join(best, (F.col("doc_id") == F.col(own)) & (named[k] == best[k])).select(best[k], F.struct(*docs.columns).alias(own))
    kept = chosen.groupBy(k).agg(F.min(own).alias(own)).select(*(F.col(own)[c].alias(c) for c in docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every row of ``documents``."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
