"""Approximate nearest neighbours by learned partitions (cosine).

1. A bounded sample (``sample_rows`` vectors, those of smallest hash of their id) gives a graph of each vector's nearest
   neighbours, and the graph is cut into parts of near equal size with few edges between them: halving along the
   principal direction, then passes that move vectors to the part most of their neighbours are in, within a capacity.
2. A small classifier (softmax regression) learns the part from the vector.  It is all that leaves the sample: one row
   of weights a part.
3. The number of parts grows with the table, ``part_rows`` vectors each.  Where more than ``most_parts`` are due, each of
   these is divided again in the same way, by a sample, a graph and a classifier of its own (at most as many as keep all
   weights within ``weight_bytes``); from there on the parts grow.
4. Every vector of the table is indexed in the part the classifiers find likeliest; queries go to the most probable
   parts, until the parts' probabilities sum to ``mass`` and the parts hold enough vectors.
5. Neighbouring parts of about ``block_rows`` vectors in all are one bundle, which meets the queries of its parts; it gives
   each query the nearest in the parts that the query goes to, by exact cosine in double precision, and the bundles'
   answers are merged.

No part is capped: a bundle that one large part makes larger is just more blocks, and so is one with very many queries.  Of equal vectors
in a block only the smallest ids are compared (one more than are asked for), which changes no answer.  The rows that
move are each vector once for each block of queries of its part, and each query once for each block of the parts it
goes to.

Defined cases: vectors that are null, all zero, hold null or non-finite components, or have another length than most
take no part, neither as queries nor as candidates; rows of null id neither; repeated ids count once, with the nearest
of their vectors; ties go to the smaller id; a query with fewer candidates than asked for gets all of them; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, table
from .wordscan import mix


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8_192
    neighbours: int = 10
    part_rows: int = 200
    most_parts: int = 256
    weight_bytes: int = 32 << 20
    mass: float = 0.99
    block_rows: int = 4_096
    query_rows: int = 1_024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors (fewer rows: all)."""
    n = len(x)
    k = min(k, n - 1)
    out = np.zeros((n, k), np.int64)
    for a in range(0, n, 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 0.1, passes: int = 12) -> np.ndarray:
    """A part for each vertex of a neighbour graph: near equal sizes, few edges cut."""
    n = len(x)
    part = np.zeros(n, np.int64)
    todo, made = [(np.arange(n), parts)], 0
    while todo:
        own, k = todo.pop()
        if k == 1 or len(own) < 2:
            part[own] = made
            made += 1
            continue
        centred = x[own] - x[own].mean(0)
        direction = np.linalg.svd(centred[:2048], full_matrices=False)[2][0]
        order = own[np.argsort(centred @ direction, kind="stable")]
        at = len(own) * (k // 2) // k
        todo += [(order[:at], k // 2), (order[at:], k - k // 2)]
    most = int(np.ceil(n / parts * (1 + slack)))
    heads, tails = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    heads, tails = np.concatenate([heads, tails]), np.concatenate([tails, heads])
    for _ in range(passes):
        votes = np.zeros((n, parts))
        np.add.at(votes, (heads, part[tails]), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        best, size, moved = votes.argmax(1), np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def classifier(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 200, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression by Adam: weights of shape (dimensions + 1, parts)."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = np.zeros((a.shape[1], parts), np.float32)
    target = np.eye(parts, dtype=np.float32)[part]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = a.T @ (softmax(a @ w) - target) / len(a) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def fit(x: np.ndarray, parts: int, s: Settings) -> np.ndarray:
    x = unit(x)
    part = balanced(x, graph(x, s.neighbours), parts)
    return classifier(x, part, parts)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, cosine) of the k nearest of each query among rows of another id; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    begin = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    keep = np.sort(order[place <= k])
    ids, x = ids[keep], x[keep].astype(np.float64)
    q = q.astype(np.float64)
    norm, query_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    near = (q / query_norm[:, None]) @ (x / norm[:, None]).T
    near[query_ids[:, None] == ids[None]] = -np.inf
    if len(ids) > k:
        bar = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((near >= bar[:, None] - 1e-9) & np.isfinite(near))
    else:
        row, col = np.nonzero(np.isfinite(near))
    score = (q[row] * x[col]).sum(1) / (query_norm[row] * norm[col])
    order = np.lexsort((ids[col], -score, row))
    row, found, score = row[order], ids[col][order], score[order]
    if len(np.unique(ids)) < len(ids):  # the same id with several vectors: its nearest counts
        _, first = np.unique(np.stack([row, found]), axis=1, return_index=True)
        first.sort()
        row, found, score = row[first], found[first], score[first]
    begin = np.searchsorted(row, np.arange(len(q)))
    top = np.arange(len(row)) - begin[row] < k
    return row[top], found[top], score[top]


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def valid(vectors: DataFrame) -> tuple[DataFrame, str, int]:
    """(vec_id, v binary) of the rows that take part, the components' kind and number."""
    kind = "f8" if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else "f4"
    known = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", "embedding")
    common = known.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common.n if common else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("embedding")), size))
            x = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)
            at = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            yield pa.record_batch([own.column("vec_id").take(pa.array(at)), pa.array([x[i].tobytes() for i in at.tolist()], pa.binary())], ["vec_id", "v"])

    return known.mapInArrow(work, "vec_id bigint, v binary"), kind, size


class Router:
    """The classifiers: of the parts, and of the parts within each of them (none: they are not divided)."""

    def __init__(self, first: np.ndarray, second: dict[int, np.ndarray], subs: int):
        self.first, self.second, self.subs = first, second, subs
        self.leaves = first.shape[1] * subs

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors with a one at the end, probability of each part)."""
        a = np.hstack([unit(x.astype(np.float64)), np.ones((len(x), 1))])
        return a, softmax(a @ self.first)

    def within(self, a: np.ndarray, part: int) -> np.ndarray:
        if part not in self.second:
            return np.eye(1, self.subs).repeat(len(a), 0)
        return softmax(a @ self.second[part])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The likeliest leaf of each vector."""
        a, p = self.shares(x)
        part = p.argmax(1)
        leaf = part * self.subs
        if self.subs > 1:
            for c in np.unique(part):
                at = np.flatnonzero(part == c)
                leaf[at] += self.within(a[at], int(c)).argmax(1)
        return leaf

    def route(self, x: np.ndarray, held: np.ndarray, mass: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, leaf) of the leaves that each vector is to be looked up in, the most probable ones."""
        a, p = self.shares(x)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        near = (np.cumsum(ranked, 1) - ranked < (1 + mass) / 2) | (np.cumsum(held.reshape(-1, self.subs).sum(1)[order], 1) <= k)
        rows, columns = np.nonzero(near | (np.arange(p.shape[1]) == 0))
        parts = order[rows, columns]
        row, leaf, share = [], [], []
        for c in np.unique(parts):
            at = rows[parts == c]
            row.append(np.repeat(at, self.subs))
            leaf.append(np.tile(np.arange(self.subs) + c * self.subs, len(at)))
            share.append((self.within(a[at], int(c)) * p[at, c][:, None]).ravel())
        row, leaf, share = (np.concatenate(v) for v in (row, leaf, share))
        some = held[leaf] > 0
        row, leaf, share = row[some], leaf[some], share[some]
        order = np.lexsort((leaf, -share, row))
        row, leaf, share = row[order], leaf[order], share[order]
        begin = np.searchsorted(row, np.arange(len(x)))[row]

        def before(v: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(v)])
            return total[:-1] - total[begin]

        keep = (before(share) < mass) | (before(held[leaf]) <= k)
        return row[keep], leaf[keep]


def trained(rows: DataFrame, kind: str, size: int, s: Settings) -> Router:
    """The router for (vec_id, v) rows; samples are those of smallest hash, or of a share of hashes within each part."""
    n = rows.count()
    due = max(1, -(-n // s.part_rows))
    parts = min(s.most_parts, due)
    subs = max(1, min(-(-due // parts), s.most_parts, s.weight_bytes // (4 * parts * (size + 1))))
    router = Router(np.zeros((size + 1, parts), np.float32), {}, 1)

    def fitted(t: pa.Table, k: int) -> bytes:
        t = t.sort_by([("vec_id", "ascending"), ("v", "ascending")])
        return fit(_matrix(t["v"], kind, size).astype(np.float64), k, s).tobytes()

    if parts > 1:

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array([fitted(pa.Table.from_batches(list(batches)), parts)], pa.binary())], ["w"])

        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(s.sample_rows)
        weights = sample.repartition(1).mapInArrow(learn, "w binary").first().w
        router = Router(np.frombuffer(weights, np.float32).reshape(size + 1, parts), {}, 1)
    if subs > 1:
        held = np.ones(parts)
        placed = cut(rows.mapInArrow(_placer(router, kind, size), "vec_id bigint, v binary, part int"), "placed")
        for row in placed.groupBy("part").count().collect():  # one row a part
            held[row.part] = row["count"]
        limits = np.minimum(s.sample_rows / held, 1.0)

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                share = (mix(batch.column("vec_id").to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                yield batch.take(pa.array(np.flatnonzero(share < limits[batch.column("part").to_numpy()])))

        def learn_part(t: pa.Table) -> pa.Table:
            return pa.table({"part": t["part"].slice(0, 1), "w": pa.array([fitted(t, subs) if t.num_rows >= subs else None], pa.binary())})

        second = placed.mapInArrow(sampled, "vec_id bigint, v binary, part int").groupBy("part").applyInArrow(learn_part, "part int, w binary").collect()
        router = Router(router.first, {r.part: np.frombuffer(r.w, np.float32).reshape(size + 1, subs) for r in second if r.w}, subs)
        drop(placed)
    return router


def _placer(router: Router, kind: str, size: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = router.place(_matrix(batch.column("v"), kind, size)) if batch.num_rows else np.zeros(0, int)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(leaf, pa.int32())], ["vec_id", "v", "part"])

    return place


def search(vectors: DataFrame, wanted: F.Column, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``vectors`` (vec_id, embedding) that is ``wanted``."""
    s = settings
    rows, kind, size = valid(vectors)
    rows = cut(rows, "vectors")
    router = trained(rows, kind, size, s)
    index = cut(rows.mapInArrow(_placer(router, kind, size), "vec_id bigint, v binary, part int"), "index")
    drop(rows)

    def counted(df: DataFrame, column: str, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for row in df.groupBy(column).count().collect():  # one row a part
            out[row[column]] = row["count"]
        return out

    held = counted(index, "part", router.leaves)
    bundle_of = (np.cumsum(held) - held) // s.block_rows
    bundle_of = np.unique(bundle_of, return_inverse=True)[1]
    n = int(bundle_of.max()) + 1

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, leaf = router.route(_matrix(batch.column("v"), kind, size), held, s.mass, k)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order].astype(np.int32)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (bundle_of[leaf[1:]] != bundle_of[leaf[:-1]])
            begin = np.flatnonzero(new)
            take = pa.array(row[begin])
            leaves = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(leaf))
            yield pa.record_batch([batch.column("vec_id").take(take), batch.column("v").take(take), leaves, pa.array(bundle_of[leaf[begin]], pa.int32())], ["vec_id", "v", "part", "bundle"])

    queries = cut(index.where(wanted).select("vec_id", "v").mapInArrow(routed, "vec_id bigint, v binary, part array<int>, bundle int"), "queries")
    asked = counted(queries, "bundle", n)
    blocks = np.maximum(1, np.bincount(bundle_of, weights=held, minlength=n).astype(np.int64) // s.block_rows)
    groups = np.maximum(1, -(-asked // s.query_rows))

    def dealt(own: np.ndarray, other: np.ndarray, names: tuple[str, str], of_index: bool):
        """Each row in its block of its own kind, once for each block of the other kind in its bundle."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bundle = bundle_of[batch.column("part").to_numpy()] if of_index else batch.column("bundle").to_numpy()
                mine = (mix(batch.column("vec_id").to_numpy().view(np.uint64)) % own[bundle].astype(np.uint64)).astype(np.int32)
                times = np.where(asked[bundle] > 0, other[bundle], 0)
                row = np.repeat(np.arange(len(bundle)), times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                columns = dict(zip(names, (pa.array(mine[row], pa.int32()), pa.array(nth.astype(np.int32), pa.int32())), strict=True))
                yield pa.record_batch([*(batch.column(c).take(take) for c in ("vec_id", "v", "part")), pa.array(bundle[row].astype(np.int32)), columns["block"], columns["group"]], ["vec_id", "v", "part", "bundle", "block", "group"])

        return work

    left = index.mapInArrow(dealt(blocks, groups, ("block", "group"), True), "vec_id bigint, v binary, part int, bundle int, block int, group int")
    right = queries.mapInArrow(dealt(groups, blocks, ("group", "block"), False), "vec_id bigint, v binary, part array<int>, bundle int, block int, group int")

    def answer(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x, part = a["vec_id"].to_numpy(), _matrix(a["v"], kind, size), a["part"].to_numpy()
        query_ids, q, lists = b["vec_id"].to_numpy(), _matrix(b["v"], kind, size), b["part"].combine_chunks()
        leaf = lists.flatten().to_numpy()
        query = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        row, found, score = [], [], []
        for p in np.unique(part):
            at, asks = np.flatnonzero(part == p), query[leaf == p]
            if len(asks):
                r, f, c = nearest(ids[at], x[at], query_ids[asks], q[asks], k)
                row, found, score = [*row, asks[r]], [*found, f], [*score, c]
        if not row:
            return answer(a.slice(0, 0), b)
        row, found, score = (np.concatenate(v) for v in (row, found, score))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k + len(ids) - len(np.unique(ids))  # an id can have several vectors
        return pa.table({"query_id": pa.array(query_ids[row[top]]), "vec_id": pa.array(found[top]), "score": pa.array(score[top])})

    keys = ["bundle", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of each of ``embeddings`` whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
