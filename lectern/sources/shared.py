"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_STAGED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, as in tests on one machine, a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            base = found.rsplit("/", 1)[0]
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="lectern-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}-{label}"
    _WRITTEN.append((spark, path))
    return path


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables as ``staged`` gave them, which nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, _STAGED.pop(t))


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is written or collected in here deletes its shuffle files when it ends; else they lie until the driver's JVM collects
    garbage. No DataFrame may be collected twice in here."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is None:
            return
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
