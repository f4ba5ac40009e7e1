"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each text becomes the set of its hashed words, pairs of neighbouring words and pairs with one word between them.
FTRL-proximal keeps a step size for each coordinate and drives weak coordinates to exactly zero (L1), so that the
model is a few thousand (coordinate, weight) rows whatever the corpus; these are what the scoring tasks get.

Bounds, both parameters: ``sample_rows`` labelled documents at most are learnt from (those with the smallest hash of
their id, so any run takes the same ones), and the model has ``2**bits`` coordinates.  Scoring reads every whole text
once, in one pass without a shuffle.

Defined cases: a null text counts as empty; an empty text gets the score of the intercept; labels that are null or
not 0/1 are ignored; of contradicting labels of one document 1 counts; with no usable labels, or labels of one
class only, the intercept alone is learnt (without any labels all scores are 0); repeated rows are scored each;
other columns of the inputs are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordscan
from .common import table


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    sample_rows: int = 16_000
    epochs: int = 8
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    positive_weight: float = 2.0


@dataclass(frozen=True)
class Model:
    bits: int
    intercept: float
    index: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def coordinates(words: wordscan.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of all words, word pairs and skip pairs, with repetitions."""
    h, t = words.hash, words.text
    texts, hashes = [t], [h]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = t[:-gap] == t[gap:]
            texts.append(t[:-gap][same])
            hashes.append(wordscan.mix(h[:-gap][same] * np.uint64(factor) + h[gap:][same]))
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wordscan.slices(batch, "text"):
            text, at = coordinates(wordscan.scan(part.column("text")), bits)
            pairs = np.unique(text << bits | at)
            ends = np.searchsorted(pairs >> bits, np.arange(part.num_rows + 1))
            at = (pairs & ((1 << bits) - 1)).astype(np.int32)
            yield pa.record_batch([part.column("doc_id"), part.column("toxic"), pa.array([at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "toxic", "at"])


def ftrl(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of (distinct coordinates, label), in the order given; returns intercept, coordinates, weights."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for at, label in rows:
            w, root, wb = weights(z[at], n[at]), np.sqrt(n[at]), -zb / ((s.beta + math.sqrt(nb)) / s.alpha)
            p = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w.sum()) + wb))))
            g = (p - label) * (s.positive_weight if label else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / s.alpha * w
            n[at] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / s.alpha * wb
            nb += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return -zb / ((s.beta + math.sqrt(nb)) / s.alpha), at, w[at]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    One task runs the descent, over at most ``sample_rows`` sets of coordinates; the driver gets the nonzero weights.
    """
    s = settings
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    sets = chosen.select("doc_id", "toxic", "text").mapInArrow(lambda it: _sets(it, s.bits), f"doc_id {kind}, toxic int, at binary")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id: dict = {}
        for batch in batches:
            for i, label, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "at")), strict=True):
                if i not in by_id or at < by_id[i][1]:
                    by_id[i] = (label, at)
        order = sorted(by_id, key=lambda i: (wordscan.mix(np.array([hash(i) & (2**64 - 1)], np.uint64))[0], i))
        b, at, w = ftrl([(np.frombuffer(by_id[i][1], np.int32), by_id[i][0]) for i in order], s) if order else (0.0, np.zeros(0, int), np.zeros(0))
        by_id.clear()
        yield pa.record_batch([pa.array([-1, *at.tolist()], pa.int32()), pa.array([b, *w.tolist()], pa.float64())], ["at", "weight"])

    got = sets.repartition(1).mapInArrow(learn, "at int, weight double").toArrow()
    at, w = got["at"].to_numpy(), got["weight"].to_numpy()
    order = np.argsort(at)
    at, w = at[order], w[order]
    return Model(s.bits, float(w[0]) if len(w) else 0.0, at[1:].astype(np.int64), w[1:])


def scores(texts: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    """The scores of some whole texts; ``dense``: the model's weights by coordinate."""
    text, at = coordinates(wordscan.scan(texts), model.bits)
    hit = dense[at] != 0
    pairs = np.unique(text[hit] << model.bits | at[hit])
    total = np.bincount(pairs >> model.bits, weights=dense[pairs & ((1 << model.bits) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total + model.intercept, -35, 35)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as (the columns ``keep``, by default all; score double); one pass over the whole texts.

    A column that is already named score is replaced.
    """
    names = [c for c in keep or docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(scores(part.column("text"), model, dense), pa.float64())], [*names, "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text and any other columns, score among them) that are scored under ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                yield part.take(pa.array(np.flatnonzero(scores(part.column("text"), model, dense) < most)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fifth of ids that is never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.where(~held_out()), labels.where(~held_out()), settings)
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
