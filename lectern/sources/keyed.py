"""Keyed tables whose upserts rewrite what they touch.

A table lies in folders by a hashed bucket of its keys. An upsert finds the buckets of its rows first, reads only those, and
writes only those anew by Spark's dynamic partition overwrite; the files of all others stay as they are. Rows within a bucket are
dealt by key ranges, so a bucket of any size is several tasks and files.

Each version is a file below ``_versions``. A writer first makes the next version's claim, which the file system lets only one
do; whoever comes second, or expected another version, fails before a row is written. A writer that died leaves its claim:
``repair`` writes the claimed buckets again from the staged rows, which lie beside it until the version is there.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lectern.operators.tables import upsert
from lectern.sources.shared import delete

BUCKET = "__bucket"


class Conflict(Exception):
    """Another writer was first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # files ------------------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._at("_versions")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _text(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/_versions/{name}").collect())

    def _put(self, name: str, text: str) -> None:
        """A file that was not there before."""
        fs, path = self._at(f"_versions/{name}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"{name} of {self.path} is there already") from e
        out.write(bytearray(text.encode()))
        out.close()

    # reading ----------------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The number of upserts so far."""
        return max([int(n) for n in self._names() if n.isdigit()], default=0)

    def _schema(self) -> StructType | None:
        at = self.version()
        return StructType.fromJson(json.loads(self._text(f"{at:012d}"))["schema"]) if at else None

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._schema().add(BUCKET, IntegerType())).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """The newest version."""
        if not self.version():
            raise AnalysisException(f"{self.path} has no version yet")
        return self._stored().drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows with these keys; only their buckets are read."""
        asked = keys.select(*self.keys).distinct()
        return self._stored().filter(F.col(BUCKET).isin(self._buckets_of(asked))).join(asked, self.keys, "left_semi").drop(BUCKET)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    # writing ----------------------------------------------------------------------------------------------------------

    def upsert(self, new: DataFrame, expected: int | None = None) -> int:
        """Rows of ``new`` replace those of their keys, others are added; returns the version, which is to be ``expected`` + 1 if that
        is given. Of several new rows of one key one is taken. No rows make no version."""
        return self._change(new, lambda old: new if old is None else upsert(old, new, self.keys), expected)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """Rows with these keys go."""
        if not self.version():
            return 0
        gone = keys.select(*self.keys).distinct()
        return self._change(gone, lambda old: old.join(gone, self.keys, "left_anti"), expected)

    def _change(self, touching: DataFrame, change, expected: int | None) -> int:
        at = self.version()
        if expected is not None and expected != at:
            raise Conflict(f"{self.path} is at version {at}, not {expected}")
        touched = self._buckets_of(touching)
        if not touched:
            return at
        number = f"{at + 1:012d}"
        rows = change(self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET) if at else None).dropDuplicates(self.keys)
        self._put(f"{number}.claim", json.dumps({"buckets": touched, "schema": rows.schema.jsonValue()}))
        try:
            # what is overwritten cannot be read at the same time
            rows.withColumn(BUCKET, self._bucket()).write.mode("overwrite").parquet(f"{self.path}/_staged/{number}")
        except Exception:
            delete(self.spark, f"{self.path}/_versions/{number}.claim")
            raise
        self._put(f"{number}.ready", "")
        return self.repair()

    def repair(self) -> int:
        """Finish the version that is claimed, or take its claim back if its rows were not staged to the end. Returns the version. Only
        for a writer that is sure that the one who made the claim is dead, or is the one."""
        names, at = self._names(), self.version()
        number = f"{at + 1:012d}"
        if f"{number}.claim" not in names:
            return at
        if f"{number}.ready" in names:
            claimed = json.loads(self._text(f"{number}.claim"))
            schema = StructType.fromJson(claimed["schema"])
            rows = self.spark.read.schema(schema.add(BUCKET, IntegerType())).parquet(f"{self.path}/_staged/{number}")
            shards = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = rows.repartitionByRange(shards, BUCKET, *self.keys).sortWithinPartitions(BUCKET, *self.keys)
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
            # a bucket that has lost all its rows has nothing that could overwrite it
            full = {r[0] for r in rows.select(BUCKET).distinct().collect()}
            for bucket in set(claimed["buckets"]) - full:
                delete(self.spark, f"{self.path}/rows/{BUCKET}={bucket}")
            self._put(number, self._text(f"{number}.claim"))
        for name in (f"_versions/{number}.ready", f"_versions/{number}.claim", f"_staged/{number}"):
            delete(self.spark, f"{self.path}/{name}")
        return self.version()
