"""Byte-balanced shards by Karmarkar-Karp differencing, cell by cell.

Rows of equal text form a group, and a group is never divided.  Differencing starts with one partial partition a
group (its bytes in one part, nothing in the others), and again and again takes the two partial partitions of largest
spread and joins them oppositely ordered: the largest part of one with the smallest of the other.  What is left in the
end is one partition into shards, whose sums lie closer together than those of greedy placement.

One heap over all groups of a corpus would be one task, so it is done in two steps.  The ``cell_groups`` largest
groups are differenced first, by one task, into one vector of shard sums; oversized groups are all among them.  The
others are dealt by hash into cells of about ``cell_groups``, and each cell is differenced by its own task together
with its share of that first vector as one more partial partition: so the small groups of every cell fill up what the
large ones have left uneven, and the cells' sums add up evenly without a further step.  Every task holds one cell.

The law that holds is ``bytes``: sizes near equal, as far as whole groups allow (one group of a third of all bytes
makes its shard that large).  Slots number the rows of a shard from 0 without gaps.  Rows that are equal in id and text
are counted first and take a run of slots, so what is numbered, in chunks, are different rows; the counts of the chunks
before are added, and long runs are written out by several tasks.

Defined cases: a null text has 0 bytes and groups with the empty text; a null doc_id is an ordinary id; repeated rows
keep their own slots; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, table

SHARDS = 24
CELL_GROUPS = 4_000
CHUNK_ROWS = 4_000
RUN_ROWS = 10_000
OVERHEAD = 8


def difference(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions (one a row, one column a part): the final part of each part of each row."""
    n, k = sums.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    vectors = {i: sums[i] for i in range(n)}
    heap = [(-float(v.max() - v.min()), i) for i, v in vectors.items()]
    heapq.heapify(heap)
    joined: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    nodes = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = vectors.pop(a), vectors.pop(b)
        down, up = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        z = x[down] + y[up]
        joined.append((a, down, b, up))
        vectors[nodes] = z
        heapq.heappush(heap, (-float(z.max() - z.min()), nodes))
        nodes += 1
    place = {heap[0][1]: np.arange(k)}
    for node in range(nodes - 1, n - 1, -1):
        own = place.pop(node)
        a, down, b, up = joined[node - n]
        for child, order in ((a, down), (b, up)):
            to = np.empty(k, np.int64)
            to[order] = own
            place[child] = to
    return np.array([place[i] for i in range(n)])


def _placed(t: pa.Table, first: np.ndarray | None, shards: int) -> np.ndarray:
    """The shard of each group of a cell; ``first``: the sums that the cell has to even out, as a share of one."""
    sizes = t["bytes"].to_numpy().astype(np.float64)
    start = np.zeros((len(sizes) + (first is not None), shards))
    start[: len(sizes), 0] = sizes
    if first is None:
        return difference(start)[:, 0]
    start[-1] = first * sizes.sum()
    place = difference(start)
    label = np.empty(shards, np.int64)
    label[place[-1]] = np.arange(shards)
    return label[place[:-1, 0]]


def assign(groups: DataFrame, shards: int = SHARDS, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """(key binary, bytes bigint) groups to (key, shard int)."""
    groups = cut(groups.select("key", "bytes"), "groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    order = [("bytes", "descending"), ("key", "ascending")]

    def largest(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        return pa.table({"key": t["key"], "bytes": t["bytes"], "shard": pa.array(_placed(t, None, shards), pa.int32())})

    top = groups.orderBy(F.desc("bytes"), "key").limit(cell_groups)
    top = cut(top.groupBy(F.lit(0).alias("cell")).applyInArrow(lambda t: largest(t.drop_columns(["cell"]) if "cell" in t.column_names else t), "key binary, bytes bigint, shard int"), "top")
    sums = np.zeros(shards)
    for row in top.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # at most one row a shard
        sums[row.shard] = row.bytes
    share = sums / max(1.0, float(total) - sums.sum())

    def cell(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        return pa.table({"key": t["key"], "shard": pa.array(_placed(t, share, shards), pa.int32())})

    rest = groups.join(F.broadcast(top.select("key")), "key", "left_anti").withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // cell_groups)))))
    return top.select("key", "shard").unionByName(rest.groupBy("cell").applyInArrow(cell, "key binary, shard int"))


def shard(docs: DataFrame, shards: int = SHARDS, cell_groups: int = CELL_GROUPS, chunk_rows: int = CHUNK_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, size, text_crc32, shard and its slot there."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    alike = cut(rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n")), "alike")
    shard_of = assign(alike.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), shards, cell_groups)
    placed = cut(alike.join(shard_of, "key"), "placed")
    drop(alike)
    chunks = max(1, -(-placed.count() // chunk_rows))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)))
    before = placed.groupBy("shard", "chunk").agg(F.sum("n").alias("held")).select("shard", "chunk", (F.sum("held").over(W.partitionBy("shard").orderBy("chunk")) - F.col("held")).alias("before"))
    own = F.sum("n").over(W.partitionBy("shard", "chunk").orderBy("doc_id", "key").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = placed.withColumn("own", own).join(before, ["shard", "chunk"]).withColumn("first", F.col("before") + F.col("own") - F.col("n"))
    names = ["doc_id", "size", "text_crc32", "shard"]

    def written(runs: DataFrame) -> DataFrame:
        return runs.select(*names, F.explode(F.sequence(F.col("first").cast("long"), (F.col("first") + F.col("n") - 1).cast("long"))).alias("slot"))

    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / run_rows).cast("int")))
    long = numbered.where(F.col("n") > run_rows).withColumn("piece", piece)
    long = long.withColumn("first", F.col("first") + F.col("piece") * run_rows).withColumn("n", F.least(F.col("n") - F.col("piece") * run_rows, F.lit(run_rows)))
    return written(numbered.where(F.col("n") <= run_rows)).unionByName(written(long.repartition("shard", "first")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 24 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
