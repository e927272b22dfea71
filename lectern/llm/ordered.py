"""Running sums over a global order, without gathering rows: range partitions are summed where they lie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lectern.llm.staging import new_path


def running(df: DataFrame, order: list[str], sums: dict[str, str], label: str = "", path: str | None = None) -> tuple[DataFrame, list[tuple]]:
    """``df`` in range partitions by ``order``, written down, with the partition's number and, for each item of ``sums``,
    the sum over the rows before in that partition; and per partition (number, totals before it...), then (None, totals)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = list(sums.items())
    base = list(df.columns)

    def run(batches):
        pid, totals = TaskContext.get().partitionId(), [0] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c) for c in base]
            for k, (src, _) in enumerate(names):
                v = b.column(src).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v)
                cols.append(pa.array(c - v + totals[k]))
                totals[k] += int(c[-1])
            cols.append(pa.array(np.full(b.num_rows, pid, np.int32)))
            yield pa.RecordBatch.from_arrays(cols, names=[*base, *[x for _, x in names], "pid"])

    schema = StructType(list(df.schema.fields))
    for _, x in names:
        schema.add(x, LongType())
    schema.add("pid", IntegerType())
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema)
    path = path or new_path(df.sparkSession, label)
    dealt.write.parquet(path)
    kept = df.sparkSession.read.schema(schema).parquet(path)
    rows = kept.groupBy("pid").agg(*[F.max(F.struct(x, (F.col(x) + F.col(src)).alias("t")))["t"].alias(x) for src, x in names]).orderBy("pid").collect()
    before, sofar = [], [0] * len(names)
    for r in rows:
        before.append((r[0], *sofar))
        sofar = [a + b for a, b in zip(sofar, r[1:], strict=True)]
    return kept, [*before, (None, *sofar)]


def with_offsets(kept: DataFrame, before: list[tuple], columns: list[str]) -> DataFrame:
    """Make the sums over the partition sums over the whole. One small row for each partition is broadcast."""
    rows = [b for b in before if b[0] is not None]
    spark = kept.sparkSession
    if not rows:
        return kept.drop("pid")
    names = ["pid", *[f"__{c}" for c in columns]]
    small = spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"`{x}` {'int' if x == 'pid' else 'long'}" for x in names))
    out = kept.join(F.broadcast(small), "pid")
    return out.withColumns({c: F.col(c) + F.col(f"__{c}") for c in columns}).drop(*names)
