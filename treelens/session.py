"""Session defaults and the shared folder for results that cut lineage."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs on one machine (tests) is a
    temporary folder made and set.
    """
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="treelens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: where many small rows are made, none of them in a cycle, it takes a third of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Shared:
    """A broadcast value that executors read without importing this package.

    Each reading unpacks it anew and keeps nothing, so that a worker that is
    done with it, and waits for other tasks, holds no memory for it.
    """

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        out = pickle.loads(self._bytes.value)
        if self._bytes._path is not None:
            self._bytes.__dict__.pop("_value", None)  # it is read again from its file if need be
        return out

    def unpersist(self) -> None:
        self._bytes.unpersist()


def saved(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder, computed in one pass; with ``parts``, rows that are equal in these columns lie together."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/treelens-result-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def tasks(spark: SparkSession) -> int:
    """Partitions for rows that Python works on: by their bytes, which are few, they would be put in too few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


class Steps:
    """Tables of the rounds of an iteration, in the shared folder until the last one is there.

    As files they have a size that the optimizer knows, so that small ones are
    broadcast by it; what is kept survives the executors that wrote it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.at = f"{shared_dir(spark).rstrip('/')}/treelens-steps-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.at}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.n}")

    def last(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of its own; those of the rounds are removed."""
        out = saved(df)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return out
