"""Sharding with near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Differencing keeps partial partitions: vectors of the bytes of each shard. It
takes the two with the largest spread and adds them oppositely ordered, the
largest shard of one to the smallest of the other, until one is left.

Groups (equal texts) are summed before anything moves. Their keys fall in at
most ITEMS items; items fall in buckets of about BUCKET_ITEMS, each differenced
in a task of its own; the buckets' partial partitions, at most BUCKETS, are
differenced on the driver. No step holds more than a fixed number of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_of, written

ITEMS, BUCKETS, BUCKET_ITEMS = 1 << 24, 1024, 4096
#: Rows of one numbering task, about.
SLOTS = 50_000
#: Parts of a shard that are numbered apart, at most; the table of their sizes is broadcast.
MAX_SUBS = 16_384
#: Item tables up to this many rows (of three numbers) are broadcast.
BROADCAST_ROWS = 200_000


def differencing(parts: Sequence[Sequence[int]]) -> list[list[int]]:
    """Where each shard of each partial partition goes: out[i][j] is the shard of part i's shard j."""
    k = len(parts[0]) if parts else 0
    heap: list[tuple] = []
    for i, p in enumerate(parts):
        order = sorted(range(k), key=lambda j: (-p[j], j))
        heap.append((p[order[-1]] - p[order[0]] if k else 0, i, [p[j] for j in order], [[(i, j)] for j in order]))
    heapq.heapify(heap)
    new = len(parts)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, more = heapq.heappop(heap)
        # the larger list of members takes the other in, so that joining stays cheap
        both = []
        for x, y, p, q in zip(a, reversed(b), own, reversed(more)):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            both.append((x + y, p))
        both.sort(key=lambda t: -t[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], new, [t[0] for t in both], [t[1] for t in both]))
        new += 1
    out = [[0] * k for _ in parts]
    for shard, members in enumerate(heap[0][3] if heap else []):
        for i, j in members:
            out[i][j] = shard
    return out


def _item(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row (and all of it as ``row``, with ``carry``).

    size: UTF-8 bytes of the text plus 1. A null text counts as an empty
    one. Equal texts share a shard, however many they are; one group larger
    than a shard's part makes that shard larger. Slots run from 0 in each
    shard without gaps, by a hash of the row's id and text; repeated rows get
    slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size, item = (F.octet_length(text) + 1).cast("long"), _item(text)
    spark = docs.sparkSession
    items = docs.select(item.alias("item"), size.alias("size")).groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    items = written(items, "shard-items")
    n_items, n_rows = items.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    buckets = max(1, min(BUCKETS, -(-n_items // BUCKET_ITEMS)))

    def deal(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["bytes", "item"], ignore_index=True)
        where = differencing([[int(b)] + [0] * (n_shards - 1) for b in x.bytes])
        x["part"] = [w[0] for w in where]
        return x[["bucket", "item", "bytes", "part"]]

    dealt = items.withColumn("bucket", F.col("item") % buckets).groupBy("bucket").applyInPandas(deal, "bucket long, item long, bytes long, part int")
    dealt = written(dealt, "shard-dealt")
    sums = {(r.bucket, r.part): r.n for r in dealt.groupBy("bucket", "part").agg(F.sum("bytes").alias("n")).collect()}
    order = sorted({b for b, _ in sums})
    final = differencing([[sums.get((b, p), 0) for p in range(n_shards)] for b in order])
    goes = spark.createDataFrame([(b, p, s) for b, w in zip(order, final) for p, s in enumerate(w)], "bucket long, part int, shard int")
    where = dealt.join(F.broadcast(goes), ["bucket", "part"]).select("item", "shard")
    where = F.broadcast(where) if n_items <= BROADCAST_ROWS else where
    subs = max(1, min(MAX_SUBS, n_rows // (n_shards * SLOTS)))
    row = [row_of(docs.columns)] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"), item.alias("item"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), *row)
    rows = rows.join(where, "item").withColumn("sub", F.pmod("key", F.lit(subs)))
    earlier = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("key", "doc_id"))
    rows = rows.withColumn("n", own).join(F.broadcast(counts), ["shard", "sub"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), *["row"] * carry)


def write(docs: DataFrame, path: str, n_shards: int = 8, **how) -> None:
    """``docs`` as Parquet in one folder for each shard, in the order of their slots within each file."""
    rows = shards(docs, n_shards, carry=True, **how).repartition("shard", F.floor(F.col("slot") / SLOTS)).sortWithinPartitions("shard", "slot")
    rows.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)
