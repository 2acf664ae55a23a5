"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half of it
from each. A fingerprint is cut in ``segments``; a pair within the radius is
within ``radius // segments`` in one of them, so every fingerprint emits, for
each segment, all variants within half of that. The variants are shuffled,
fingerprints that meet at a variant are verified over all 64 bits, and each
pair counts at one variant only. With one segment these are all variants within
half the radius of the whole fingerprint (2081 at radius 4); with two they are 66.

Only distinct fingerprints take part. A variant that more than ``bucket``
fingerprints share is refined exactly: these emit the variants of their other
bits within half the radius too, which bounds what can meet by a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, col, components, map_arrow, popcount, row_of, text_key, tidy, unpacked, written

#: Shingles hashed at once; bounds memory on very long texts.
CHUNK = 1 << 16
#: Groups up to this size report their verified pairs; larger ones a spanning forest of them.
PAIRS = 16
#: Fingerprints at one variant before it is refined.
BUCKET = 2048


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned integer; no words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= shingle:
        return digest(joined)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = (end - length + 1)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(start), CHUNK):
        part = [joined[a:b] for a, b in zip(start[i : i + CHUNK], end[i : i + CHUNK])]
        bits = np.fromiter(map(digest, part), np.dtype("<u8"), len(part)).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the text's key, for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fp), *batch.columns[2:]], ["doc_id", "fp", "_k1", "_k2"])

    text = col(text_col).cast("string")
    return map_arrow(docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_key(text)), run, "doc_id long, fp long, _k1 long, _k2 long")


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of all changes of up to ``radius`` of ``bits`` bits."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(masks, np.uint64)


def middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one variant between a and b at which a pair counts: half of the differing bits changed, lowest first."""
    diff, out = a ^ b, np.zeros_like(a)
    half = popcount(diff) // 2
    for i in range(int(half.max(initial=0))):
        low = np.where(half > i, diff & (~diff + np.uint64(1)), np.uint64(0))
        out, diff = out | low, diff ^ low
    return np.minimum(a ^ out, b ^ out)


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of one group, which has a bounded size."""
    left, a, b = np.ones(len(fp), bool), [], []
    for i in range(len(fp)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            j = todo.pop()
            near = np.flatnonzero(left & (popcount(fp ^ fp[j]) <= radius))
            left[near] = False
            a.append(np.full(len(near), fp[j])), b.append(fp[near])
            todo += near.tolist()
            if not left.any():
                break
    join = lambda x: np.concatenate(x) if x else fp[:0]
    return join(a), join(b)


def _verified(bucket: np.ndarray, fp: np.ndarray, keep, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among whole groups of equal buckets, in order; ``keep``: which pairs count at their bucket."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, len(bucket)])
    a, b = [], []
    for k in np.flatnonzero(size > PAIRS):
        x, y = _forest(fp[first[k] : first[k] + size[k]], radius)
        a.append(x), b.append(y)
    rest = (size > 1) & (size <= PAIRS)
    row, last = np.repeat(first[rest], size[rest]), np.repeat((first + size)[rest], size[rest])
    row = row + np.arange(len(row)) - np.repeat(np.cumsum(size[rest]) - size[rest], size[rest])
    for step in range(1, PAIRS):
        ok = row + step < last
        row, last = row[ok], last[ok]
        if not len(row):
            break
        x, y = fp[row], fp[row + step]
        near = popcount(x ^ y) <= radius
        x, y, at = x[near], y[near], bucket[row[near]]
        near = keep(x, y, at)
        a.append(x[near]), b.append(y[near])
    join = lambda x: np.concatenate(x) if x else fp[:0]
    return join(a), join(b)


def _met(rows: DataFrame, radius: int, segments: int, most: int | None) -> DataFrame:
    """Verified pairs (u, v) of rows (bucket, fp); with ``most``, rows of larger buckets come back (bucket, u) instead.

    The rows of a bucket come in order, and no more than ``most`` of them are held.
    """
    width = 64 // segments
    low = np.uint64((1 << width) - 1) if width < 64 else np.uint64(2**64 - 1)

    def keep(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        ok, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for k in range(segments):
            shift = np.uint64(k * width)
            p, q = (x >> shift) & low, (y >> shift) & low
            here = ~done & (popcount(p ^ q) <= radius // segments)
            done |= here
            ok |= here & (at == (middle(p, q) | np.uint64(k) << np.uint64(width % 64)))
        return ok

    def batch(a: np.ndarray, b: np.ndarray, over: np.ndarray | None = None) -> pa.RecordBatch:
        held = [pa.array(x.view(np.int64)) for x in (a, b)]
        return pa.record_batch([*held, pa.array(over.view(np.int64)) if over is not None else pa.nulls(len(a), pa.int64())], ["u", "v", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [np.zeros(0, np.uint64)] * 2
        large = None
        for x in batches:
            new = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in x.columns]
            if large is not None:
                same = new[0] == large
                if same.any():
                    yield batch(new[1][same], new[1][same], new[0][same])
                    new = [c[~same] for c in new]
                if not len(new[0]):
                    continue
                large = None
            cols = [np.concatenate(c) for c in zip(cols, new)]
            cut = int(np.searchsorted(cols[0].view(np.int64), cols[0].view(np.int64)[-1]))
            yield from whole(*[c[:cut] for c in cols])
            cols = [c[cut:] for c in cols]
            if most and len(cols[0]) > most:
                large = cols[0][0]
                yield batch(cols[1], cols[1], cols[0])
                cols = [c[:0] for c in cols]
        yield from whole(*cols)

    def whole(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(bucket):
            return
        if most:
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[first, len(bucket)])
            over = np.repeat(size > most, size)
            if over.any():
                yield batch(fp[over], fp[over], bucket[over])
                bucket, fp = bucket[~over], fp[~over]
        if len(bucket):
            yield batch(*_verified(bucket, fp, keep if most else lambda x, y, at: np.ones(len(x), bool), radius))

    return rows.mapInArrow(tidy(run), "u long, v long, bucket long")


def links(distinct: DataFrame, radius: int = 4, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fp`` within ``radius`` bits."""
    width = 64 // segments
    masks, rest = ball(width, -(-(radius // segments) // 2)), 64 - width

    def emit(x: pa.RecordBatch) -> pa.RecordBatch:
        fp = x.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        out = []
        for k in range(segments):
            part = (fp >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            out.append((part[:, None] ^ masks[None, :]).ravel() | np.uint64(k) << np.uint64(width % 64))
        return pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(np.repeat(fp, len(masks)), segments).view(np.int64))], ["bucket", "fp"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            for i in range(0, x.num_rows, 1024):
                yield emit(x.slice(i, 1024))

    rows = distinct.select("fp").mapInArrow(tidy(batches), "bucket long, fp long")
    met = written(_met(rows.repartition("bucket").sortWithinPartitions("bucket", "fp"), radius, segments, bucket if segments > 1 else None), "simhash-met")
    edges, over = met.where("bucket is null").select("u", "v"), met.where("bucket is not null")
    if segments == 1 or over.isEmpty():
        return edges

    more = ball(rest, radius // 2)

    def refine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            for i in range(0, x.num_rows, 256):
                at, fp = (c.slice(i, 256).to_numpy(zero_copy_only=False).view(np.uint64) for c in x.columns)
                k = (at >> np.uint64(width)) * np.uint64(width)
                hole = np.uint64((1 << width) - 1) << k
                below = (np.uint64(1) << k) - np.uint64(1)
                # the other bits, closed up where the segment was
                other = (fp & below) | ((fp & ~(hole | below)) >> np.uint64(width))
                key = (other[:, None] ^ more[None, :]).ravel()
                n = len(more)
                yield pa.record_batch([pa.array(v.view(np.int64)) for v in (np.repeat(at, n), key, np.repeat(fp, n))], ["at", "key", "fp"])

    fine = over.select(F.col("bucket").alias("at"), F.col("u").alias("fp")).mapInArrow(tidy(refine), "at long, key long, fp long")
    fine = fine.select(F.xxhash64("at", "key").alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return edges.union(_met(fine, radius, segments, None).select("u", "v"))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """doc_id, fp, root (a fingerprint of its component), component_id and text key of every row of ``docs``.

    component_id is the smallest doc_id among all rows whose fingerprints are
    linked, over any number of steps. A null or empty text has fingerprint 0
    and is linked like any other; rows with a null id are linked, and their
    component has a null id only if it holds no other. Repeated rows stay.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct, radius, segments)).withColumnRenamed("node", "fp")
    linked = found.join(distinct, "fp")
    # written, so that the join of a very large component with its id can be split
    ids = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    by_fp = distinct.join(found.join(ids, "root").select("fp", "root", "component_id"), "fp", "left")
    alone = F.col("root").isNull()
    by_fp = by_fp.select("fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # both sides are read from files, so that a fingerprint with very many rows is a skewed join that Spark can split
    return rows.join(written(by_fp, "simhash-component"), "fp").select("doc_id", "fp", "root", "component_id", "_k1", "_k2")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (then text key), whole."""
    rows = clusters(docs, id_col, text_col, **how)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    keep = rows.groupBy("root").agg(F.min(first).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("_id"), F.col("k._k1").alias("_q1"), F.col("k._k2").alias("_q2"))
    own = docs.select(row_of(docs.columns), *text_key(col(text_col).cast("string")), col(id_col).cast("long").alias("_own"))
    same = (own["_k1"] == keep["_q1"]) & (own["_k2"] == keep["_q2"]) & own["_own"].eqNullSafe(keep["_id"])
    return own.join(keep, same, "left_semi").dropDuplicates(["_k1", "_k2", "_own"]).select(*unpacked(docs.columns))
