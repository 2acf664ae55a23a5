"""Files that change, as a stream: parsed once, by content, and kept for the next analysis.

This is an addition: the batch analysis is whole without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions import scalars as s
from treelens.sources import pyast


def changed(spark: SparkSession, path: str) -> DataFrame:
    """New files below ``path`` as they come: path, context, content and modified (microseconds)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(path)
    own = F.regexp_replace("path", r"^\w+:/*", "/")
    return rows.select(own.alias("path"), s.file_context(F.substring_index(own, "/", -1)).alias("context"), "content", F.unix_micros("modificationTime").alias("modified"))


def keep_parsed(files: DataFrame, table: str, checkpoint: str, layout: str = "src"):
    """A query that keeps the parsed form of files in a table, each content of a path once in a batch.

    A batch has a folder of its own, so one that is run again replaces what it wrote.
    """

    def batch(rows: DataFrame, n: int) -> None:
        fresh = rows.withColumn("content_hash", F.sha2("content", 256)).groupBy("path", "context", "content_hash").agg(F.first("content").alias("content"), F.max("modified").alias("modified"))
        pyast.parsed(fresh, layout, ("content_hash", "modified")).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The last parsed form of each file: of the last batch, in it of the last change."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("path").agg(F.max(F.struct("batch", "modified", "content_hash")).alias("last")).select("path", "last.*")
    return rows.join(last, ["path", "batch", "modified", "content_hash"], "left_semi")
