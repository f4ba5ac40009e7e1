"""Removal of long repeats: byte strings of ``LENGTH`` bytes that also start anywhere else, by prefix doubling over the
positions that may still repeat.

Prefix doubling gives each position a rank by its first k bytes, sorts pairs of ranks k apart for the ranks by 2 k bytes,
and drops positions whose rank is unique, until the length is reached.  Over all positions of a corpus that is several
sorts of many times its size, so two rounds go before that leave few of them:

1. Names of ``SEED`` bytes, as ranks by the first bytes.  Of the positions in each window of LENGTH bytes, the one whose
   SEED-byte string has the smallest hash is the window's anchor, leftmost among equals; equal windows have equal anchors
   at equal offsets.  About one position in (LENGTH - SEED) / 2 is an anchor.  Anchors of unique name are dropped, and
   with them all their windows.
2. Names of whole runs.  The windows of one anchor are a run, and the run's bytes have a name too: runs of equal names
   have all their windows in common.  Only runs that are alone with their name, under an anchor name that others share,
   stay open.
3. Doubling.  Spark brings open runs, and one run of each name that they could share a part with, together by their
   anchor's name.  There the positions are ranked by SEED bytes, then by sorted pairs of ranks 2, 4, ... times as far
   (the last step reaches LENGTH exactly); after each step positions of unique rank are dropped, and with them the
   windows that need them.  Windows that are left have a second start.

Names are 64 bits wide; two different strings count as equal only if the names of their runs, or of the SEED-byte strings
that they consist of, agree by chance: with n strings that meet, that has a probability of n * n / 2 ** 65.  Ranks from
there on are exact.  Then the covered bytes are removed document by document.

Hot strings: runs are counted before the shuffle; an anchor name with more than ``GROUP`` open runs is dealt over
several tasks by names of whole windows.  Documents longer than ``PIECE`` bytes are read in overlapping pieces.

Defined cases: a null text counts as empty; texts under LENGTH bytes lose nothing; matches never cross documents; rows
that repeat id and text are documents of their own, so each loses what the others have; other columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan
from .common import cut, drop, table

LENGTH = 200
SEED = 40
GROUP = 20_000
PIECE = 4 << 20
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values: prefix and suffix minima of blocks of that width."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


class Prefix:
    """Polynomial prefix sums of some bytes: the name of any of their strings."""

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        up, self.down = wordscan.powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return wordscan.mix((self.sums[end] - self.sums[start]) * self.down[start])


def runs(flat: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """All runs of windows of one anchor: (text, first window, windows, offset of the anchor, name of anchor, name of run)."""
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(sizes.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = Prefix(flat)
    at = np.arange(len(flat) - seed + 1)
    names = prefix.name(at, at + seed)
    least = sliding_min((names & ~_LOW) | at.astype(np.uint64), length - seed + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[text]
    anchor = (least[window] & _LOW).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first_at = np.flatnonzero(new)
    first, text, anchor = window[first_at], text[first_at], anchor[first_at]
    count = np.diff(np.append(first_at, total))
    whole = prefix.name(first, first + count - 1 + length)
    run_name = wordscan.mix(whole + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (anchor - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return text, first, count, anchor - first, names[anchor], run_name


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, number of the first text, where the piece starts in it); long texts in pieces that overlap."""
    flat, ends = wordscan.raw(column)
    if len(ends) == 2 and len(flat) > PIECE:
        for a in range(0, len(flat) - length + 1, PIECE):
            part = flat[a : a + PIECE + length - 1]
            yield part, np.array([0, len(part)]), 0, a
    else:
        yield flat, ends, 0, 0


def _all_runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                for flat, ends, _, base in _pieces(part.column("text"), length):
                    text, first, count, offset, name, run = runs(flat, ends, length, seed)
                    place = first - ends[text] + base
                    rows = pa.array(text)
                    yield pa.record_batch(
                        [part.column("doc_id").take(rows), part.column("t").take(rows), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(offset.astype(np.int16)), pa.array(name.view(np.int64)), pa.array(run.view(np.int64))],
                        ["doc_id", "t", "first", "n", "off", "name", "run"],
                    )

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, first int, n smallint, off smallint, name bigint, run bigint")


def ranked(values: np.ndarray) -> np.ndarray:
    """Ranks of values by sorting, from 1 on; 0 for those that are alone."""
    _, rank, seen = np.unique(values, return_inverse=True, return_counts=True)
    return np.where(seen[rank] > 1, rank + 1, 0).astype(np.uint64)


def steps(length: int, seed: int) -> list[tuple[int, int, list[int]]]:
    """(length before, distance of the pair, where in a window the ranks after it are needed) of each step of doubling."""
    sizes = [seed]
    while sizes[-1] < length:
        sizes.append(min(2 * sizes[-1], length))
    needed = {length: [0]}
    for k, after in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        needed[k] = sorted({at + move for at in needed[after] for move in (0, after - k)})
    return [(0, 0, needed[seed])] + [(k, after - k, needed[after]) for k, after in zip(sizes, sizes[1:], strict=False)]


def doubled(flat: np.ndarray, windows: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Which of the windows (their first bytes in ``flat``) have an equal one among them, by prefix doubling."""
    alive, rank = np.arange(len(windows)), np.zeros(0, np.uint64)
    prefix = Prefix(flat)
    for k, move, needed in steps(length, seed):
        at = windows[alive]
        due = np.zeros(len(flat), bool)
        for n in needed:
            due[at + n] = True
        at_due = np.flatnonzero(due)
        values = rank[at_due] << np.uint64(32) | rank[at_due + move] if k else prefix.name(at_due, at_due + seed)
        rank = np.zeros(len(flat) + 1, np.uint64)
        rank[at_due] = ranked(values)
        for n in needed:
            alive = alive[rank[windows[alive] + n] > 0]
    out = np.zeros(len(windows), bool)
    out[alive] = True
    return out


def _windows(t: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, name within the anchor's name) of every window of runs given with their bytes."""
    flat, ends = wordscan.raw(t.column("bytes"))
    count = t.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = ends[:-1][row] + offset
    return row, offset, wordscan.mix(Prefix(flat).name(at, at + length) ^ wordscan.mix(t.column("name").to_numpy().view(np.uint64))[row])


def _compared(held: DataFrame, length: int, seed: int, cell_rows: int) -> DataFrame:
    """(doc_id, t, low, high): what windows with a partner cover, of the open ones among runs of one task's anchor names."""
    cells = max(1, -(-held.count() // cell_rows))
    kind = held.schema["doc_id"].dataType.simpleString()

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flat, ends = wordscan.raw(t.column("bytes"))
        count = t.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = doubled(flat, ends[:-1][row] + offset, length, seed) & t["open"].to_numpy()[row]
        row, low = row[hit], t["first"].to_numpy().astype(np.int64)[row[hit]] + offset[hit]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1 if len(row) else begin
        take = pa.array(row[begin])
        return pa.table({"doc_id": t["doc_id"].take(take), "t": t["t"].take(take), "low": pa.array(low[begin].astype(np.int32)), "high": pa.array((low[end] + length).astype(np.int32))})

    return held.withColumn("cell", F.pmod("name", F.lit(cells))).groupBy("cell").applyInArrow(work, f"doc_id {kind}, t bigint, low int, high int")


def _compared_apart(held: DataFrame, length: int) -> DataFrame:
    """The same for anchor names of very many runs: each window's name is a key of its own."""
    kind = held.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "bytes", 1 << 18):
                row, offset, name = _windows(part, length)
                take = pa.array(row)
                low = part.column("first").to_numpy().astype(np.int64)[row] + offset
                yield pa.record_batch([*(part.column(c).take(take) for c in ("doc_id", "t", "open")), pa.array(low.astype(np.int32)), pa.array(name.view(np.int64))], ["doc_id", "t", "open", "low", "window"])

    rows = held.mapInArrow(work, f"doc_id {kind}, t bigint, open boolean, low int, window bigint")
    several = rows.groupBy("window").count().where("count > 1").select("window")
    return rows.where("open").join(several, "window").select("doc_id", "t", "low", (F.col("low") + length).alias("high"))


def repeated(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP, cell_rows: int = 2_000) -> DataFrame:
    """Spans (doc_id, t, low, high) of bytes of ``docs`` (doc_id, t, text) that strings of ``length`` with a second start cover."""
    every = _all_runs(docs, length, seed).withColumn("own", F.xxhash64("doc_id", "t", "first"))
    classes = every.groupBy("name", "run").agg(F.count("*").alias("alike"), F.min("own").alias("one"))
    names = classes.groupBy("name").agg(F.sum("alike").alias("all"), F.count("*").alias("kinds"), F.count_if(F.col("alike") == 1).alias("singles")).where("all > 1")
    known = classes.join(names, "name").where("alike > 1 or kinds > 1")
    found = every.join(known, ["name", "run"]).select("doc_id", "t", "first", "n", "off", "name", (F.col("alike") == 1).alias("open"), ((F.col("alike") > 1) & (F.col("singles") > 0) & (F.col("own") == F.col("one"))).alias("partner"), (F.col("kinds") > group).alias("many"))
    found = cut(found, "runs")
    shared = found.where("not open").select("doc_id", "t", F.col("first").alias("low"), (F.col("first") + F.col("n") - 1 + length).cast("int").alias("high"))
    lists = found.where("open or partner").groupBy(F.col("doc_id").alias("l_id"), F.col("t").alias("l_t")).agg(F.collect_set(F.struct("first", "n", "name", "open", "many")).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                flat, ends = wordscan.raw(part.column("text"))
                lists = part.column("runs")
                own = lists.flatten()
                count = lists.value_lengths().to_numpy()
                first, n = (own.field(c).to_numpy().astype(np.int64) for c in ("first", "n"))
                row = np.repeat(np.arange(len(count)), count)
                low = ends[:-1][row] + first
                take = pa.array(row)
                pieces = pa.array([flat[a:b].tobytes() for a, b in zip(low, low + n - 1 + length, strict=True)], pa.binary())
                yield pa.record_batch([part.column("doc_id").take(take), part.column("t").take(take), *(own.field(c) for c in ("first", "n", "name", "open", "many")), pieces], ["doc_id", "t", "first", "n", "name", "open", "many", "bytes"])

    joined = docs.join(lists, (F.col("t") == F.col("l_t")) & F.col("doc_id").eqNullSafe(F.col("l_id"))).select("doc_id", "t", "text", "runs")
    held = cut(joined.mapInArrow(bytes_of, f"doc_id {kind}, t bigint, first int, n smallint, name bigint, open boolean, many boolean, bytes binary"), "open")
    parts = _compared(held.where("not many"), length, seed, cell_rows).unionByName(_compared_apart(held.where("many"), length))
    spans = cut(shared.unionByName(parts), "spans")
    drop(held), drop(found)
    return spans


def removed(docs: DataFrame, length: int = LENGTH, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept_sha256, and on demand the kept bytes."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    spans = repeated(docs, length, seed)
    lists = spans.groupBy(F.col("doc_id").alias("l_id"), F.col("t").alias("l_t")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                flat, ends = wordscan.raw(part.column("text"))
                lists = part.column("spans")
                count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                own = lists.flatten()
                row = np.repeat(np.arange(len(count)), count)
                change = np.zeros(len(flat) + 1, np.int64)
                np.add.at(change, ends[:-1][row] + own.field("low").to_numpy(), 1)
                np.add.at(change, ends[:-1][row] + own.field("high").to_numpy(), -1)
                gone = np.cumsum(change)[:-1] > 0
                out = []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    mask = gone[a:b]
                    kept = flat[a:b][~mask].tobytes() if b > a else b""
                    starts = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if b > a else 0
                    out.append((int(b - a), int(mask.sum()), starts, hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(made)])]
                yield pa.record_batch([part.column("doc_id"), *columns], ["doc_id", *made])

    joined = docs.join(lists, (F.col("t") == F.col("l_t")) & F.col("doc_id").eqNullSafe(F.col("l_id")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of long repeats leaves of ``documents``."""
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
