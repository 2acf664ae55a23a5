"""What several operators share: words, Arrow helpers, written tables and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from treelens.session import cut, shared_dir

#: ASCII other than digits and small letters becomes a space; capital letters become small; other bytes stay.
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of digits, letters a-z and everything beyond ASCII."""
    return text.translate(ALNUM).split() if text else []


def col(name: str):
    """A column by its exact name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(names: list[str]):
    """Columns as one struct, so that no name of theirs meets one of ours."""
    return (F.struct(*[col(c) for c in names]) if names else F.struct(F.lit(0).alias("__none"))).alias("row")


def unpacked(names: list[str]) -> list:
    return [F.col("row")[c].alias(c) for c in names]


def with_fields(fields: list, ddl: str) -> StructType:
    """A schema of given fields and further ones."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a string column without decoding it."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(f, batches)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory of this process, which its allocators still hold, back to the system."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; at its end the worker gives freed memory back.

    A worker process outlives its task and waits for others. What its
    allocators still hold then counts beside the workers of later stages.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/treelens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more, and lets Spark drop the shuffle files of plans that are done."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def text_key(text) -> list:
    """Two columns that stand for a text in joins and groupings (128 bits; null has its own)."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("treelens"), F.length(text), text).alias("_k2")]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has long columns u and v. Returns node and root, the smallest
    node reachable, for every node that is on an edge. Each round is two
    aggregations and two joins on the edges; nothing is gathered, and a hub
    is split by the skewed-join rule. Lineage is cut each round.
    """

    def pair(a, b):
        return [a.alias("u"), b.alias("v")]

    def sign(df: DataFrame):
        h = F.xxhash64("u", "v")
        return df.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()

    u, v = F.col("u"), F.col("v")
    now = cut(edges.where(u != v).select(*pair(F.greatest(u, v), F.least(u, v))).distinct())
    state = sign(now)
    while state[0]:
        both = now.union(now.select(*pair(v, u)))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(v > u).select(*pair(v, F.col("m"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(*pair(v, F.col("m")))
        now, before = cut(small.union(least.select(*pair(u, F.col("m")))).distinct()), state
        state = sign(now)
        if tuple(state) == tuple(before):
            break
    return now.select(u.alias("node"), v.alias("root")).union(now.select(v.alias("node"), v.alias("root")).distinct())


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``limit`` bytes together (a longer one stands alone)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows:
        yield batch.slice(start)


def word_ids(text: bytes | None, ids: dict[bytes, int], piece: int = 4 << 20) -> np.ndarray:
    """Number of each word in ``ids``, else -1; a very long text is cut at spaces, so its words are never all objects at once."""
    text, out, start = (text or b"").translate(ALNUM), [], 0
    while start < len(text):
        end = len(text) if len(text) - start <= piece else text.rfind(b" ", start, start + piece) + 1 or (text.find(b" ", start + piece) + 1 or len(text))
        end = end if end > start else len(text)
        words = text[start:end].split()
        out.append(np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words)))
        start = end
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.int32)


def pieces(text: str | None, most: int = 4 << 20) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut at spaces where it has any."""
    text, start = text or "", 0
    while len(text) - start > most:
        end = text.rfind(" ", start, start + most) + 1
        end = end if end > start else text.find(" ", start + most) + 1 or len(text)
        yield text[start:end]
        start = end
    if start < len(text) or not text:
        yield text[start:]


def labelled(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may be learnt from: not those whose remainder is ``held_out``.

    Of rows that disagree on a document the larger label counts; null ids and labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id", divisor) != held_out))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; of an empty text for a null id."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def examples(docs: DataFrame, labels: DataFrame, per_class: int, text_col: str = "text") -> DataFrame:
    """doc_id, label and text of at most ``per_class`` labelled documents of each label, by a hash of the id."""
    parts = [labels.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
