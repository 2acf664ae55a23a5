"""Benchmark passages in documents, by a prefix-filtered set join.

Every item is cut in windows of ``window`` words (a shorter item is one
window), every window in shingles. Shingles are ordered by rarity, counted over
all documents. A document that contains a window contains all its shingles, so
for whole containment the necessary prefix of a window is its one rarest
shingle: only that is joined. A meeting fixes where the window must begin; it
must lie within the document (length and positional bound), and then all
its words are compared.

The windows are broadcast in blocks of at most ``block_bytes`` of windows and
owners, as they are held; items are cut in pieces first, so a long one may lie
in several blocks. A block is one pass over the documents for the counts and
one for the search, without any shuffle of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.session import Shared

from .common import alnum_words, as_bytes, by_bytes, col, discard, row_of, text_key, tidy, unpacked, with_fields, word_ids, written

SPANS = "array<struct<start: long, end: long>>"
MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
#: Bytes that a window takes beside its words.
OWNER = 12
#: Word count of a text as a pattern; the same words as alnum_words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hash(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word numbers (in each row, if there are rows); meaningless where one is -1."""
    n = ids.shape[-1] - size + 1
    out = np.full((*ids.shape[:-1], max(n, 0)), size, np.uint64)
    for j in range(size if n > 0 else 0):
        out = (out ^ ids[..., j : j + n].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


def _sought(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, where each begins in the sorted ones, how often it is there, and a bit filter before the search."""
    hashes, first, count = np.unique(hashes, return_index=True, return_counts=True)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return hashes, first, count, bits


@dataclass
class Block:
    """Windows of some items: word numbers by length, owners, and the shingles to look for."""

    vocab: dict[bytes, int]
    items: list[str]
    windows: dict[int, np.ndarray]  # by length: a row of word numbers each
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: where the items of each window begin, and their numbers
    found: dict[int, tuple]  # by shingle size: what to look for

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes | None]], window: int) -> Block:
        vocab: dict[bytes, int] = {}
        names: dict[str, int] = {}
        rows: dict[int, list] = {}
        for item, text in items:
            ids = np.array([vocab.setdefault(w, len(vocab)) for w in alnum_words(text)], np.int32)
            size = min(window, len(ids))
            if size:
                own = -1 if item is None else names.setdefault(item, len(names))
                rows.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), own))
        windows, owners = {}, {}
        for size in sorted(rows):
            every = np.concatenate([w for w, _ in rows[size]])
            own = np.repeat(np.array([o for _, o in rows[size]], np.int64), [len(w) for w, _ in rows.pop(size)])
            _, first, which = np.unique(every.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
            windows[size] = every[first]
            pairs = np.unique(which[own >= 0] * np.int64(max(1, len(names))) + own[own >= 0])
            edge = np.searchsorted(pairs // max(1, len(names)), np.arange(len(first) + 1))
            owners[size] = edge, (pairs % max(1, len(names))).astype(np.int32)
        return cls(vocab, list(names), windows, owners, {})

    def owned_by(self, length: int, window: int) -> list[str]:
        edge, items = self.owners[length]
        return [self.items[i] for i in items[edge[window] : edge[window + 1]].tolist()]

    def shingles(self, shingle: int) -> dict[int, np.ndarray]:
        """By length of windows: the hash of every shingle of every window."""
        return {length: _hash(rows, min(shingle, length)) for length, rows in self.windows.items()}

    def counter(self, shingle: int) -> Block:
        """What is needed to count all shingles: no windows, no owners."""
        by_size: dict[int, list] = {}
        for length, h in self.shingles(shingle).items():
            by_size.setdefault(min(shingle, length), []).append(h.ravel())
        return Block(self.vocab, [], {}, {}, {s: _sought(np.concatenate(h)) for s, h in by_size.items()})

    def look_for(self, shingle: int, hashes: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> None:
        """Look for the rarest shingle of each window, by the counts of the distinct ``hashes`` of each size."""
        parts: dict[int, list] = {}
        for length, h in self.shingles(shingle).items():
            size = min(shingle, length)
            at = counts[size][np.searchsorted(hashes[size], h)].argmin(axis=1)
            row = np.arange(len(h))
            parts.setdefault(size, []).append((h[row, at], np.full(len(h), length, np.int32), row.astype(np.int32), at.astype(np.int32)))
        for size, some in parts.items():
            h, *rest = (np.concatenate(c) for c in zip(*some))
            order = np.argsort(h, kind="stable")
            self.found[size] = (*_sought(h[order]), *[c[order] for c in rest])

    def meetings(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` of shingles to look for, and their numbers."""
        hashes, _, _, bits, *_ = self.found[size]
        h = _hash(ids, size)
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(bits[h >> np.uint64(64 - FILTER_BITS)])
        for j in range(size):
            at = at[ids[at + j] >= 0]
        k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        same = hashes[k] == h[at]
        return at[same], k[same]

    def match(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Starts, length and window numbers of the windows that occur; begin, end: bounds of the text at each position."""
        for size, (_, first, count, _, length, window, offset) in self.found.items():
            at, k = self.meetings(ids, size)
            for i in range(0, len(at), 1 << 16):
                a, b = at[i : i + (1 << 16)], k[i : i + (1 << 16)]
                reps = count[b]
                row = np.repeat(first[b] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
                a = np.repeat(a, reps)
                start, stop = a - offset[row], a - offset[row] + length[row]
                ok = (start >= begin[a]) & (stop <= end[a])
                for n in np.unique(length[row[ok]]).tolist():
                    x = ok & (length[row] == n)
                    s, w = start[x], window[row[x]]
                    step = max(1, (1 << 20) // n)
                    for c in range(0, len(s), step):
                        p, q = s[c : c + step], w[c : c + step]
                        same = (ids[p[:, None] + np.arange(n)] == self.windows[n][q]).all(axis=1)
                        if same.any():
                            yield p[same], n, q[same]


def _numbered(texts: list[bytes | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, and where each begins (one more at the end)."""
    parts = [word_ids(t, vocab) for t in texts]
    edge = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), edge


def _count(docs: DataFrame, block, size_of: dict[int, int]) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents, by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        total = {s: np.zeros(n, np.int64) for s, n in size_of.items()}
        for whole in batches:
            for x in by_bytes(whole, 0):
                # a -1 after each text keeps shingles within it
                ids = np.concatenate([np.r_[word_ids(t, b.vocab), np.int32(-1)].astype(np.int32) for t in as_bytes(x.column(0))])
                for s in total:
                    total[s] += np.bincount(b.meetings(ids, s)[1], minlength=len(total[s]))
        for s, n in total.items():
            k = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(k), s)), pa.array(k), pa.array(n[k])], ["size", "k", "n"])

    out = {s: np.zeros(n, np.int64) for s, n in size_of.items()}
    counted = docs.mapInArrow(tidy(run), "size long, k long, n long").groupBy("size", "k").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():
        out[r["size"]][r["k"]] = r["n"]
    return out


def prepare(docs: DataFrame, items: list[tuple[str | None, bytes | None]], window: int, shingle: int):
    """A broadcast block of ``items`` with the rarest shingle of each window to look for; None without windows."""
    spark = docs.sparkSession
    block = Block.build(items, window)
    if not block.windows:
        return None
    counter = block.counter(shingle)
    shared = Shared(spark, counter)
    hashes = {s: f[0] for s, f in counter.found.items()}
    block.look_for(shingle, hashes, _count(docs, shared, {s: len(h) for s, h in hashes.items()}))
    shared.unpersist()
    return Shared(spark, block)


def pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """item_id, text and size (bytes of its windows and owners) of ``items`` in pieces of at most ``most`` windows, each window in one; distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for item, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                words = alnum_words(text)
                out = [words[i : i + most + window - 1] for i in range(0, max(1, len(words) - window + 1), most)] if words else []
                size = [max(1, len(w) - window + 1) * (4 * window + OWNER) for w in out]
                yield pa.record_batch([pa.array([item] * len(out), pa.string()), pa.array([b" ".join(w) for w in out], pa.binary()), pa.array(size, pa.int64())], ["item_id", "text", "size"])

    return items.mapInArrow(run, "item_id string, text binary, size long").distinct()


def blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The pieces of ``items`` in lists whose windows take at most ``block_bytes``, or are one bucket of pieces."""
    cut = pieces(items, window, max(window, block_bytes // (16 * (4 * window + OWNER))))
    total = cut.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if total <= block_bytes:
        yield [(r.item_id, bytes(r.text)) for r in cut.select("item_id", "text").collect()]
        return
    n = min(1 << 16, max(64, 64 * total // block_bytes))
    cut = written(cut.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "windows")
    sizes = cut.groupBy("bucket").agg(F.sum("size").alias("size")).orderBy("bucket").collect()  # at most 65,536 rows
    start, held = 0, 0
    for i, r in enumerate([*sizes, None]):
        if r is None or (held and held + r["size"] > block_bytes):
            part = cut.where(F.col("bucket").between(sizes[start]["bucket"], sizes[i - 1]["bucket"]))
            yield [(x.item_id, bytes(x.text)) for x in part.select("item_id", "text").collect()]
            start, held = i, 0
        held += r["size"] if r else 0
    discard(cut)


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _scan(rows: DataFrame, block, only_hits: bool) -> DataFrame:
    """n_words, spans and items beside the columns of ``rows``, whose first is the text."""
    out = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block | None = block.value if block is not None else None
        for whole in batches:
            for x in by_bytes(whole, 0):
                ids, edge = _numbered(as_bytes(x.column(0)), b.vocab if b else {})
                n = np.diff(edge)
                doc = np.repeat(np.arange(len(n)), n)
                turn, owners = np.zeros(len(ids) + 1, np.int32), {}
                for start, length, window in b.match(ids, edge[:-1][doc], edge[1:][doc]) if b else ():
                    np.add.at(turn, start, 1), np.add.at(turn, start + length, -1)
                    for d, w in set(zip(doc[start].tolist(), window.tolist())):
                        owners.setdefault(d, set()).update(b.owned_by(length, w))
                hit = np.cumsum(turn[:-1]) > 0
                touched = np.zeros(len(n), bool)
                touched[doc[hit]] = True
                spans = [_spans(hit[edge[i] : edge[i + 1]]) if touched[i] else [] for i in range(len(n))]
                items = [sorted(owners.get(i, ())) for i in range(len(n))]
                y = pa.record_batch([*x.columns[1:], pa.array(n), pa.array(spans, out), pa.array(items, pa.list_(pa.string()))], [*x.schema.names[1:], "n_words", "spans", "items"])
                yield y.filter(pa.array(touched)) if only_hits else y

    return rows.mapInArrow(tidy(run), with_fields(rows.schema.fields[1:], f"n_words long, spans {SPANS}, items array<string>"))


def _merged(spans: list) -> list:
    out: list = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _merge(rows: DataFrame) -> DataFrame:
    """Spans found in several passes, put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            i = x.schema.get_field_index("spans")
            yield x.set_column(i, x.schema.field(i), pa.array([_merged(s or []) for s in x.column(i).to_pylist()], x.column(i).type))

    return rows.mapInArrow(tidy(run), rows.schema)


def overlaps(docs: DataFrame, items: DataFrame, carry: list[str] | None = None, text_col: str = "text", window: int = 13, shingle: int = 5, block_bytes: int = 64 << 20) -> DataFrame:
    """For each row of ``docs``: its columns ``carry`` (all, if None), n_words, spans (hit word ranges) and items (ids as sorted strings).

    ``items`` has item_id and text. Null or empty texts have no words and
    no windows. Equal windows of several items count for all of them; an
    item with a null id marks words but is not listed; repeated rows count
    once. Columns of ``docs`` named n_words, spans or items give way to the
    new ones. The order of rows is kept; repeated documents stay.
    """
    new = ["n_words", "spans", "items"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    rows = docs.select(col(text_col).cast("string").alias("text"), row_of(carry))
    texts = rows.select("text")
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    some = blocks(own, window, block_bytes)
    first, second = next(some), next(some, None)
    if second is None:
        return _scan(rows, prepare(texts, first, window, shingle), False).select(*unpacked(carry), *new)
    passes = []
    keyed = rows.select("text", *text_key(F.col("text")))
    for part in chain([first, second], some):
        block = prepare(texts, part, window, shingle)
        if block is not None:
            passes.append(written(_scan(keyed, block, True).dropDuplicates(["_k1", "_k2"]), "decontam"))
            block.unpersist()
    if not passes:
        return _scan(rows, None, False).select(*unpacked(carry), *new)
    found = passes[0]
    for p in passes[1:]:
        found = found.union(p)
    found = found.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.select("text", "row", *text_key(F.col("text"))).join(found, ["_k1", "_k2"], "left")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    merged = _merge(joined.select("row", n.alias("n_words"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    return merged.select(*unpacked(carry), *new)


def n_hit(spans="spans"):
    """Words within the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])


def contaminated(share: int = 20):
    """The contamination rule: hit words are at least one in ``share``."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def remove(docs: DataFrame, items: DataFrame, share: int = 20, **how) -> DataFrame:
    """``docs`` without those that are contaminated."""
    kept = overlaps(docs.select(row_of(docs.columns), col(how.pop("text_col", "text")).alias("text")), items, carry=["row"], **how).where(~contaminated(share))
    return kept.select(*unpacked(docs.columns))
