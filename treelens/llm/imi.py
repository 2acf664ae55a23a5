"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook, so that a vector
falls in one of K x K cells. A query takes the cells in the order of its summed
distances to the two centroids, with a heap over the sorted halves, until they
hold enough vectors; these are ranked by their exact cosine.

Codebooks are fitted on at most SAMPLE vectors; every vector is indexed.
Equal vectors are one entry with their smallest ids, as many as a result can
show. Neighbouring cells are put together in blocks of about CHUNK vectors, a
larger cell is cut in chunks, and so are the queries of a block: a task ranks
about CHUNK vectors and QUERIES queries at once, each query those of its
cells, and only the best go on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.session import Shared

from .common import written

SAMPLE, CHUNK, QUERIES = 32_768, 4096, 512
#: Vectors of a cell on average, and the most centroids of a half.
PER_CELL, MOST = 64, 256
#: Vectors that a query ranks at least; queries of the sample that set how many more, and the recall they are set for.
CANDIDATES, TRIALS, RECALL = 2048, 256, 0.96


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of Lloyd's algorithm; centroids that lose all points stay."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def traverse(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells that hold vectors, by a[i] + b[j] from the least, until they hold ``enough``."""
    i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, k = a[i_of], b[j_of], len(b)
    heap, reach, out, total = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(i_of[i]) * k + int(j_of[j])
        if held[cell]:
            out.append(cell)
            total += int(held[cell])
        # of each row the next one, and of the first column the next row: every pair comes once
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def depth(x: np.ndarray, books: list[np.ndarray], k: int, recall: float) -> float:
    """Share of all vectors that queries must rank to find this share of their k nearest, measured within a sample of unit vectors."""
    (a, b), half = books, books[0].shape[1]
    cell = nearest(x[:, :half], a) * len(b) + nearest(x[:, half:], b)
    held = np.bincount(cell, minlength=len(a) * len(b))
    trial = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(np.int64)
    need = []
    for t in trial:
        score = x @ x[t]
        score[t] = -np.inf
        most = min(k, len(x) - 1)
        near = np.argpartition(-score, most - 1)[:most] if most else []
        far = (distances(x[t : t + 1, :half], a)[0][:, None] + distances(x[t : t + 1, half:], b)[0][None, :]).ravel()
        order = np.argsort(far, kind="stable")
        before = np.empty(len(far))
        # a cell is taken if those before it do not hold enough yet
        before[order] = np.cumsum(held[order]) - held[order]
        need += (before[cell[near]] + 1).tolist()
    return float(np.quantile(need, recall)) / len(x) if need else 1.0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, nothing in it null or not finite, not zero."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda v: v != 0), F.lit(False))


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, candidates: int = CANDIDATES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest of every row with ``is_query``.

    Score is the cosine in double precision; ties go to the smaller vec_id.
    Rows with a null id, and vectors that are null, zero, hold nulls or
    infinite components, or have another length than most, take no part. Rows
    that repeat an id are one: it has its best score, and is never its own
    neighbour. With fewer candidates all are returned; an empty table gives none.
    A query ranks ``candidates`` vectors at least, and as large a share of all
    as the recall asks for in a brute-force trial on the sample.
    """
    spark = vectors.sparkSession
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    width = lengths[0].n
    rows = rows.where(F.size("vector") == width)

    # equal vectors: the k + 1 smallest ids, one of which may be the query's own
    keys = F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("treelens"), "vector").alias("k2")
    by_vector = rows.groupBy(*keys, "vec_id").agg(F.first("vector").alias("vector"))
    few = by_vector.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = few.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = written(entries.select(F.col("k1").alias("key"), "vector", "ids"), "imi-entries")
    total = entries.count()
    half = width // 2
    n_cells = max(1, min(MOST, round((total / PER_CELL) ** 0.5)))
    sample = entries.orderBy("key").limit(SAMPLE).select("vector").toArrow() if total else None
    x = unit(_matrix(sample.column(0), width))
    size = [min(n_cells, len(np.unique(x[:, s], axis=0))) if s.start != s.stop else 1 for s in (slice(0, half), slice(half, width))]
    books = [codebook(x[:, s], n) if s.start != s.stop else np.zeros((1, 0)) for s, n in zip((slice(0, half), slice(half, width)), size)]
    enough = max(candidates, k + 1, int(np.ceil(depth(x, books, k, recall) * total)))
    shared = Shared(spark, books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for y in batches:
            x = unit(_matrix(y.column(1), width))
            cell = nearest(x[:, :half], a) * len(b) + nearest(x[:, half:], b)
            yield pa.record_batch([*y.columns, pa.array(cell.astype(np.int64))], [*y.schema.names, "cell"])

    placed = written(entries.mapInArrow(place, "key long, vector array<double>, ids array<long>, cell long"), "imi-placed")
    held = np.zeros(size[0] * size[1], np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST * MOST rows
        held[r["cell"]] = r["count"]
    block_of = (np.cumsum(held) - held) // CHUNK
    in_block = np.bincount(block_of, held).astype(np.int64)
    counts = Shared(spark, (held, block_of))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), (held, block_of) = shared.value, counts.value
        for y in batches:
            for i in range(0, y.num_rows, 256):
                part = y.slice(i, 256)
                x = unit(_matrix(part.column(1), width))
                p, q = distances(x[:, :half], a), distances(x[:, half:], b)
                row, block, cells = [], [], []
                for j in range(len(x)):
                    own = np.sort(np.array(traverse(p[j], q[j], held, enough), np.int64))
                    cut = np.flatnonzero(np.r_[True, np.diff(block_of[own]) > 0])
                    block += block_of[own[cut]].tolist()
                    cells += np.split(own, cut[1:])
                    row += [j] * len(cut)
                at = pa.array(row, pa.int64())
                yield pa.record_batch([*[c.take(at) for c in part.columns], pa.array(block, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["query_id", "query", "block", "cells"])

    queries = rows.where("is_query").select("vec_id", "vector").distinct()
    visits = written(queries.mapInArrow(visit, "query_id long, query array<double>, block long, cells array<long>"), "imi-visits")
    asked = np.zeros(len(in_block), np.int64)
    for r in visits.groupBy("block").count().collect():  # no more blocks than cells
        asked[r["block"]] = r["count"]
    parts = pd.DataFrame({"block": np.arange(len(in_block)), "chunks": np.maximum(1, -(-in_block // CHUNK)), "groups": np.maximum(1, -(-asked // QUERIES))})
    # a block of several cells may be a little above CHUNK; only a block that is one large cell is cut
    parts.loc[in_block < 2 * CHUNK, "chunks"] = 1
    parts = F.broadcast(spark.createDataFrame(parts[asked > 0], "block long, chunks long, groups long"))
    blocks = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": np.flatnonzero(held), "block": block_of[held > 0]}), "cell long, block long"))
    left = visits.join(parts, "block").select("block", F.pmod(F.xxhash64("query_id", "query"), "groups").alias("group"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "query_id", "query", "cells")
    right = placed.join(blocks, "cell").join(parts, "block").select("block", F.explode(F.expr("sequence(0, groups - 1)")).alias("group"), F.pmod(F.xxhash64("key"), "chunks").alias("chunk"), "vector", "ids", "cell")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        q, v = unit(_matrix(left["query"], width)), unit(_matrix(right["vector"], width))
        who, ids, cell = left["query_id"].to_numpy(), right["ids"].to_pylist(), right["cell"].to_numpy()
        known, cell = np.unique(cell, return_inverse=True)
        score, rows = q @ v.T, []
        for i, own in enumerate(left["cells"].to_pylist()):
            at = np.flatnonzero(np.isin(known, own)[cell])
            if not len(at):
                continue
            most = min(k + 1, len(at))
            # all that reach the last place, so that ties are settled by id
            last = np.partition(score[i, at], len(at) - most)[len(at) - most]
            best = sorted((-score[i, j], x) for j in at[score[i, at] >= last].tolist() for x in ids[j] if x != who[i])[:k]
            rows += [(int(who[i]), x, float(-s)) for s, x in best]
        return pa.table([pa.array(c) for c in zip(*rows)], schema=out) if rows else out.empty_table()

    keys = ["block", "group", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place_ = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place_).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
