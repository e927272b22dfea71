"""Incremental processing on Structured Streaming: new files, keys seen before, upserts per batch, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shared import new_path


def stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream of files, ``files`` of them a batch at most; the checkpoint of a query remembers which were read."""
    path, schema = f"{sf_dir}/{name}.parquet", spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key. Times without a zone become instants, which a watermark needs."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """Each key's first row; the keys are kept as state."""
    return events.dropDuplicates([key])


def run_to_end(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming query over all that is there and give its result as a table in the shared folder. In complete mode a
    batch replaces what stands there; in append mode it has a folder by its number, so one that is run again after a failure stands
    there once."""
    at = new_path(df.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def upsert_batches(df: DataFrame, merge, checkpoint: str) -> None:
    """Hand each batch to ``merge(batch, number)``, once each after a restart."""
    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
