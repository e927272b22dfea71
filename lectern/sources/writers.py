"""Sinks: keyed overwrite, append, full refresh, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.sources.keyed import KeyedTable


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def refresh(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def merge(spark: SparkSession, new: DataFrame, path: str, keys: list[str], version: int | None = None) -> DataFrame:
    """Upsert ``new`` into the keyed table at ``path``, which is to be at ``version`` if that is given; returns the table."""
    keyed = KeyedTable(spark, path, keys)
    keyed.upsert(new, version)
    return keyed.read()


def vectors(df: DataFrame, path: str, dim: int) -> None:
    """Points with vectors of the declared dimension; any other fails the write."""
    _of_dimension(df, dim).write.mode("overwrite").parquet(path)


def merge_vectors(spark: SparkSession, new: DataFrame, path: str, dim: int, version: int | None = None) -> DataFrame:
    """Points by id into a collection, which is made if there is none; a vector of another dimension fails the write. Returns the
    collection."""
    return merge(spark, _of_dimension(new, dim), path, ["id"], version)


def _of_dimension(df: DataFrame, dim: int) -> DataFrame:
    ok = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector does not have {dim} numbers")).cast("array<float>"))
    return df.withColumn("vector", ok)


def corpus_csv(df: DataFrame, path: str) -> None:
    """A corpus as CSV that ``readers.corpus_csv`` reads."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def append_stamped(df: DataFrame, path: str, now=None) -> None:
    """Append rows with the time at which they were found."""
    df.withColumn("ts", now if now is not None else F.current_timestamp()).write.mode("append").option("header", True).csv(path)


def interaction_log(df: DataFrame, path: str) -> None:
    log_rows(df).write.mode("append").option("header", True).csv(path)


def log_rows(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.left(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), F.lit(200)))


def counted(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "overwrite") -> dict:
    """Write ``df`` and return what the same pass counted: an aggregate for each name. A task that is run again is counted once."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.mode(mode).parquet(path)
    return seen.get
