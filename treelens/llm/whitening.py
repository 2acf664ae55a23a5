"""Whitening of embeddings by a two-pass covariance.

Vectors become integers (``floor(scale * c)``). The fit list is each distinct
integer vector once. The first pass sums it exactly, the second sums centred
outer products by matrix products in the tasks, merged as a tree; the driver
decomposes one width x width matrix and sends the projection back. Products are
centred at the mean rounded to integers, so that they and their sums are whole
numbers, exact in double below 2**53 and the same in any order of merging; what
rounding left of the mean is taken out of the merged sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.session import Shared

from .common import col, row_of, unpacked, with_fields, written

#: A component whose eigenvalue is a smaller share of the trace has no scale of its own and is left out.
LEAST = 1e-12
LONG = np.iinfo(np.int64)
#: Vectors that are projected or multiplied together.
ROWS = 4096


@dataclass
class Model:
    n: int
    width: int
    #: exact sums by dimension, as Python integers of any size
    sums: list[int]
    #: eigenvalues, falling, and unit eigenvectors as columns
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def projection(self, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return self.vectors[:, :k] / np.sqrt(self.values[:k])

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _usable(vector) -> F.Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda c: finite(c.cast("double")))


def _integers(vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, long matrix) for the rows of each width; values beyond long are its ends."""
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        at = starts[rows][:, None] + np.arange(width)
        x = np.floor(flat[at] * scale)
        yield rows, np.where(x >= 2.0**63, LONG.max, np.where(x < -(2.0**63), LONG.min, np.clip(x, -(2.0**63), 2.0**63 - 1024))).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the smallest width of integer that holds it, told by the first byte: equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(x)
    need = np.full(len(x), 1)
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x), np.int64),) * 2
    for size in (1, 2, 4):
        info = np.iinfo(f"i{size}")
        need[(low < info.min) | (high > info.max)] = size * 2
    for size in np.unique(need):
        for i in np.flatnonzero(need == size):
            out[i] = bytes([size]) + x[i].astype(f"<i{size}").tobytes()
    return out


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(rows), width), np.int64)
    sizes = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{size}").reshape(len(at), width)
    return out


def fit_list(rows: DataFrame, vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each distinct integer vector once: packed, width and how many rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _integers(b.column(0), scale):
                for start in range(0, len(at), ROWS):
                    p = _packed(x[start : start + ROWS])
                    yield pa.record_batch([pa.array(p, pa.binary()), pa.array(np.full(len(p), x.shape[1], np.int32))], ["packed", "width"])

    vectors = rows.select(col(vec_col).alias("v")).where(_usable(F.col("v")))
    return vectors.mapInArrow(run, "packed binary, width int").groupBy("packed", "width").agg(F.count("*").alias("n_rows"))


def _merged(fit: DataFrame, width: int, part: Callable[[np.ndarray], tuple], zero: tuple) -> tuple:
    """Partial results of each task's vectors, added up as a tree; what travels is as large as the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total = None
        for b in batches:
            rows = b.column(0).to_pylist()
            for start in range(0, len(rows), ROWS):
                new = part(_unpacked(rows[start : start + ROWS], width))
                total = new if total is None else tuple(x + y for x, y in zip(total, new))
        if total is not None:
            yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def loaded(row) -> tuple:
        import pickle

        return pickle.loads(bytes(row.part))

    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    parts = fit.where(F.col("width") == width).select("packed").mapInArrow(run, "part binary")
    return parts.rdd.map(loaded).treeAggregate(zero, add, add)


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = 4, scale: float = 256.0) -> Model | None:
    """The model of the fit list; None if no vector is left.

    The width is that of most rows (the larger of equal ones); vectors of
    another width take no part.
    """
    own = written(fit_list(rows, vec_col, scale), "whitening")
    most = own.groupBy("width").agg(F.sum("n_rows").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return None
    d = most.width
    high, low, n = _merged(own, d, lambda x: ((x >> 32).sum(0).astype(object), (x & 0xFFFFFFFF).sum(0).astype(object), len(x)), (np.zeros(d, object), np.zeros(d, object), 0))
    sums = [int(h) * 2**32 + int(s) for h, s in zip(high, low)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    c = np.array(centre, np.int64)

    def gram(x: np.ndarray) -> tuple:
        y = x.astype(np.float64) - c
        return (y.T @ y,)

    (total,) = _merged(own, d, gram, (np.zeros((d, d)),))
    rest = np.array([(s - m * n) / n for s, m in zip(sums, centre)])
    v = total / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(v)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(v))
    kept = values > max(LEAST * trace, 0)
    values, vectors = values[kept], vectors[:, kept]
    # of either sign, the one whose largest entry is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if len(values) else vectors
    model = Model(n, d, sums, values, vectors, trace)
    p = model.projection(components)
    m = model.mean()

    def check(x: np.ndarray) -> tuple:
        w = (x - m) @ p
        return w.T @ w, w.sum(0)

    if p.shape[1]:
        square, first = _merged(own, d, check, (np.zeros((p.shape[1],) * 2), np.zeros(p.shape[1])))
        model.identity_error = float(np.abs(square / n - np.outer(first / n, first / n) - np.eye(p.shape[1])).max())
    return model


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S) squared; null where a long does not hold it."""
    top = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if x.shape[1] * top * top <= LONG.max:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    y = x.astype(object) * n - np.array(sums, object)
    return [v if v <= LONG.max else None for v in (y * y).sum(1).tolist()]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vec_col: str = "embedding", components: int = 4, carry: list[str] | None = None, scale: float = 256.0) -> DataFrame:
    """``carry`` (all columns, if None) and, for each row and component up to ``components``, its whitened coordinate.

    component counts from 1 by falling eigenvalue; deviation is the exact sum
    over dimensions of (n * x - S)**2; explained is the component's share of
    the variance; identity_error the largest entry by which the covariance of
    what is returned, over the fit list, differs from the identity. Rows whose
    vector is null or has null, infinite or NaN entries are dropped, and those
    of another width than most; repeated rows and null ids stay. Fewer
    components come out if there are fewer with any variance: none of a single
    vector, or of equal ones, so these and an empty table give no rows.
    Columns named like ours give way.
    """
    spark = rows.sparkSession
    names = [f.split()[0] for f in OUT.split(", ")]
    carry = [c for c in (rows.columns if carry is None else carry) if c not in names]
    own = rows.select(col(vec_col).alias("v"), row_of(carry)).where(_usable(F.col("v")))
    schema = with_fields(own.schema.fields[1:], OUT)
    model = fit(rows, vec_col, components, scale)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema).select(*unpacked(carry), *names)
    shared = Shared(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        p, mean = m.projection(components), m.mean()
        k = p.shape[1]
        for b in batches:
            for at, x in _integers(b.column(0), scale):
                if x.shape[1] != m.width:
                    continue
                for start in range(0, len(at), ROWS):
                    part = x[start : start + ROWS]
                    r = len(part)
                    deviation = pa.array(_deviations(part, m.sums, m.n), pa.int64()).take(pa.array(np.repeat(np.arange(r), k)))
                    yield pa.record_batch(
                        [
                            b.column(1).take(pa.array(np.repeat(at[start : start + ROWS], k))),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                            pa.array(np.full(r * k, m.n)),
                            deviation,
                            pa.array(((part - mean) @ p).ravel()),
                            pa.array(np.tile(m.values[:k] / m.trace, r)),
                            pa.array(np.full(r * k, m.identity_error)),
                        ],
                        ["row", *names],
                    )

    return own.mapInArrow(run, schema).select(*unpacked(carry), *names)
