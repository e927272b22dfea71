"""Streams that keep their own state against the batch operators, restarts between batches included."""

from pyspark.sql import functions as F

from lectern.operators import tables
from lectern.plans import runs
from lectern.sources import writers
from lectern.sources.keyed import KeyedTable
from lectern.streaming import stateful


def test_unseen_rows_of_a_stream(spark, tmp_path):
    batches = [[("a", "x", 2), ("a", "y", 1), ("a", "x", 5), ("b", "x", 1)], [("a", "z", 1), ("a", "x", 2), ("b", "x", 9)], [("a", "w", 1), ("a", "y", 2), ("b", "q", 1), ("c", "x", 1)]]
    schema, got, want, state = "target string, key string, pos long", [], [], spark.createDataFrame([], "target string, seen array<string>")
    for batch in batches:
        df = spark.createDataFrame(batch, schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        new = []
        q = stateful.unseen(rows, "target", "key", "pos", keep=2).writeStream.outputMode("append").foreachBatch(lambda b, n: new.extend(map(tuple, b.collect())))
        q.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()  # a query of its own each time
        got.append(sorted(new))
        fresh, state = tables.unseen_rows(df.groupBy("target", "key").agg(F.min("pos").alias("pos")), state, keep=2)
        want.append(sorted(map(tuple, fresh.select("target", "key", "pos").collect())))
        state = spark.createDataFrame(state.collect(), "target string, seen array<string>")
    assert got == want and [len(x) for x in got] == [3, 1, 4]


def test_counts_of_the_pass_that_writes(spark, tmp_path):
    df = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    got = writers.counted(df, f"{tmp_path}/out", {"rows": F.count("*"), "odd": F.count_if("odd"), "most": F.max("id")})
    assert got == {"rows": 100, "odd": 50, "most": 99} and spark.read.parquet(f"{tmp_path}/out").count() == 100


def test_a_batch_makes_its_state_once(spark, monkeypatch):
    plans, upsert = [], KeyedTable.upsert

    def watched(self, new, *more):
        plans.append(new._jdf.queryExecution().optimizedPlan().toString())
        return upsert(self, new, *more)

    monkeypatch.setattr(KeyedTable, "upsert", watched)
    assert runs.conversation_stream(spark, "/root/testdata/sf0.001").count()
    assert plans and not any("State" in p for p in plans)
