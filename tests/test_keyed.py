"""Keyed tables: what an upsert touches, two writers, writers that die."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import keyed, writers
from lectern.sources.keyed import BUCKET, Conflict, KeyedTable


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/*/*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = KeyedTable(spark, path, ["k"], buckets=16)
    assert t.version() == 0 and t.delete(spark.createDataFrame([(1,)], "k long")) == 0
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert t.upsert(rows) == 1 and t.upsert(rows.limit(0)) == 1
    before = _files(path)
    assert {os.path.dirname(f) for f in before} == {f"{path}/rows/{BUCKET}={b}" for b in range(16)}
    new = spark.createDataFrame([(7, "b"), (7, "b"), (1000, "c"), (None, "d")], "k long, v string")
    assert t.upsert(new, 1) == 2
    touched = {f"{path}/rows/{BUCKET}={b}" for b in t._buckets_of(new)}
    after = _files(path)
    assert 0 < len(touched) <= 3
    for f, at in before.items():
        assert (f in after and after[f] == at) == (os.path.dirname(f) not in touched)
    want = {k: "a" for k in range(500)} | {7: "b", 1000: "c", None: "d"}
    assert {r.k: r.v for r in t.read().collect()} == want and t.read().count() == len(want)
    assert _rows(t.lookup(spark.createDataFrame([(7,), (9,), (4444,)], "k long"))) == [(7, "b"), (9, "a")]
    assert t.delete(spark.range(500).select(F.col("id").alias("k"))) == 3
    assert _rows(t.read()) == [(1000, "c"), (None, "d")]
    # another column, by another user of the same folder
    wide = KeyedTable(spark, path, ["k"], buckets=16)
    assert wide.upsert(spark.createDataFrame([(1, "x", 5)], "k long, v string, n int")) == 4
    assert _rows(t.read()) == [(1, "x", 5), (1000, "c", None), (None, "d", None)]


def test_two_writers(spark, tmp_path):
    path, row = f"{tmp_path}/t", lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    one, two = KeyedTable(spark, path, ["k"]), KeyedTable(spark, path, ["k"])
    at = one.version()
    two.upsert(row("two"), at)
    with pytest.raises(Conflict):
        one.upsert(row("one"), at)
    # at the same time: the first has the claim, the second fails before it writes a row
    one._put("000000000002.claim", "{}")
    with pytest.raises(Conflict):
        two.upsert(row("late"))
    assert _rows(one.read()) == [(1, "two")] and one.version() == 1
    assert one.repair() == 1 and two.upsert(row("again"), 1) == 2 and _rows(one.read()) == [(1, "again")]


def test_writers_that_die(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    t = KeyedTable(spark, path, ["id"])
    writers.merge_vectors(spark, spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>"), path, 2)
    # rows that cannot be made take their claim back
    with pytest.raises(Exception, match="does not have 2"):
        writers.merge_vectors(spark, spark.createDataFrame([("a", [1.0])], "id string, vector array<float>"), path, 2, 1)
    assert t.version() == 1 and not [n for n in t._names() if "claim" in n]
    # dead after staging: the claim stands, nobody else can write, repair finishes it
    monkeypatch.setattr(KeyedTable, "repair", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.upsert(spark.createDataFrame([("b", [3.0, 4.0])], "id string, vector array<float>"))
    monkeypatch.undo()
    assert t.version() == 1 and _rows(t.read().select("id")) == [("a",)]
    with pytest.raises(Conflict):
        t.upsert(spark.createDataFrame([("c", [3.0, 4.0])], "id string, vector array<float>"))
    assert t.repair() == 2 and _rows(t.read().select("id")) == [("a",), ("b",)]
    assert keyed.Conflict is Conflict
