"""Tables written between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.readers import table
from lectern.sources.shared import delete, new_path
from lectern.sources.shared import staged as materialize

__all__ = ["delete", "filter_here", "materialize", "new_path", "small_arrow", "table", "without"]

#: Rows of an Arrow batch of whole texts. Spark's 10,000 are tens of MB, held by the JVM and several times by a worker.
TEXT_ROWS = 512


@contextmanager
def small_arrow(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """What is run inside hands Python batches of so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def filter_here(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that the optimizer leaves above the projections which compute its columns: moved below them, it would have
    every expression that they share written out again for each use. A column that is not deterministic holds it there."""
    return df.withColumn("__part", F.spark_partition_id()).filter(condition & (F.col("__part") >= 0)).drop("__part")


#: Keys that are broadcast at most; their number is counted first.
BROADCAST_KEYS = 200_000


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in the one column of ``gone``. Few keys are broadcast, and ``df`` stays where
    it is; beyond ``BROADCAST_KEYS`` both are shuffled."""
    gone = materialize(gone.toDF("__gone").distinct(), "gone")
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key == F.col("__gone"), "left_anti")
