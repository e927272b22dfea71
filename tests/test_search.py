"""Stored indexes against what they stand for: exact search, plain scoring, comparing all with all."""

import os
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import containment, inverted, nearest, retrieval
from lectern.operators.inverted import InvertedIndex
from lectern.operators.nearest import Model, VectorIndex
from lectern.sources.shared import shared_dir


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _corpus(spark, n, seed=3, at=0):
    """Texts of words whose frequency falls with their number, as words' frequencies do."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(5000)]
    weight = 1 / np.arange(1, 5001)
    return [(at + k, " ".join(rng.choice(words, rng.integers(5, 120), p=weight / weight.sum()))) for k in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(_corpus(spark, 3000), "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.sample([f"w{x}" for x in range(20, 3000)], 2) + rng.sample([f"w{x}" for x in range(20)], 3))) for k in range(20)]
    return spark.createDataFrame([*rows, (100, ""), (101, None), (102, "nowhere")], "query_id long, text string")


def test_index_is_bm25_and_reads_little(spark, tmp_path, corpus, asked):
    index = InvertedIndex(spark, f"{tmp_path}/ix", grams=(), buckets=8)
    index.add(corpus)
    read = []
    got = _rows(index.search(asked, 1, read=read))
    assert got == _rows(retrieval.bm25(asked, corpus, 1, grams=())) and len(got) == 20
    lists = retrieval.query_terms(asked, grams=()).join(index._read("terms"), "term").agg(F.sum("df")).first()[0]
    took = inverted.postings_read(read)
    assert 0 < took < 0.4 * lists and took / 20 < index.counts()[2] / 50  # of the asked terms' lists; of all postings, for each query
    # all of them, and ties by the smaller id
    assert _rows(index.search(asked, 5000)) == _rows(retrieval.bm25(asked, corpus, 5000, grams=()))


def test_index_follows_changes(spark, tmp_path, asked):
    docs = spark.createDataFrame([*_corpus(spark, 300), (None, "w1 w2"), (900, None), (901, "")], "doc_id long, text string")
    index = InvertedIndex(spark, f"{tmp_path}/ix", grams=(2,), buckets=4)
    assert index.add(docs.limit(0)) is None and index.search(asked, 3).count() == 0 and index.delete(docs.select("doc_id")) == 0
    index.add(docs.filter("doc_id < 200 or doc_id is null"))
    index.add(docs.filter("doc_id >= 100"))  # half of them once more
    newer = spark.createDataFrame(_corpus(spark, 60, seed=9, at=20), "doc_id long, text string")
    index.add(newer)
    assert index.delete(spark.createDataFrame([(5,), (5,), (150,), (7777,)], "doc_id long")) == 2
    now = docs.filter("doc_id is not null").join(newer, "doc_id", "left_anti").unionByName(newer).filter("doc_id not in (5, 150)")
    want = _rows(retrieval.bm25(asked, now, 4, grams=(2,)))
    assert _rows(index.search(asked, 4)) == want and want
    assert index.counts()[0] == now.count() == index.live().count()
    # what a job that died has left is not in the log, and not read
    lost = index._all("postings").limit(50).withColumn("segment", F.lit(uuid.uuid4().hex))
    index._write(lost, "postings", "segment", "bucket")
    assert _rows(index.search(asked, 4)) == want
    before = index.counts()
    index.compact()
    assert len(index.log()) == 1 and index.counts() == before and _rows(index.search(asked, 4)) == want
    # another user of the same folder sees the same
    assert _rows(InvertedIndex(spark, f"{tmp_path}/ix", grams=(2,), buckets=4).search(asked, 4)) == want


def test_index_where_weights_are_negative(spark, tmp_path):
    """Most terms in most documents: Okapi's weights fall below 0, and nothing is left out."""
    docs = spark.createDataFrame([(k, "a b c d " + "e " * (k % 3)) for k in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a e"), (2, "b b")], "query_id long, text string")
    index = InvertedIndex(spark, f"{tmp_path}/ix", grams=(), buckets=2)
    index.add(docs)
    assert _rows(index.search(asked, 3)) == _rows(retrieval.bm25(asked, docs, 3, grams=()))


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = [(k, (centres[k % 12] + 0.4 * rng.normal(size=24)).tolist()) for k in range(2000)]
    hot = [(3000 + k, (centres[0] + 0.05 * rng.normal(size=24)).tolist()) for k in range(1500)]
    docs = spark.createDataFrame([*rows, *hot, (5000, None), (5001, [0.0] * 24), (None, [1.0] * 24), (5002, [])], "doc_id long, vector array<double>")
    asked = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    want = retrieval.dense(asked.filter("query_id < 5000"), docs.filter("doc_id < 5000 and doc_id is not null"), 5)
    index = VectorIndex(spark, f"{tmp_path}/v").build(docs.filter("doc_id is null or doc_id % 2 = 0"), 16, parts=6).add(docs.filter("doc_id % 2 = 1"))
    best = {(r.query_id, r.doc_id) for r in want.collect()}
    exact = {(r.query_id, r.doc_id) for r in index.search(asked, 5, probes=16).collect()}
    assert exact == best
    near = {(r.query_id, r.doc_id) for r in index.search(asked, 5, probes=4, depth=60).collect()}
    assert len(near & best) >= 0.95 * len(best)
    assert len({q for q, _ in near}) == 175 and index.search(asked.limit(0), 5, probes=2).count() == 0
    few = index.search(asked, 5000, probes=1 << 20).groupBy("query_id").count()
    assert few.agg(F.min("count")).first()[0] == 3500
    with pytest.raises(Exception, match="does not have 24"):
        index.add(spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<double>"))


def test_codes_are_as_far_off_as_they_say():
    x = np.random.default_rng(2).normal(size=(400, 10))
    model = Model.from_bytes(Model.fit(x, 5, 4, words=16).to_bytes())
    cell, code, error = model.encode(x)
    q = np.random.default_rng(3).normal(size=(7, 10))
    for c in range(5):
        own = np.flatnonzero(cell == c)
        true = np.sqrt(((q[:, None] - x[own][None]) ** 2).sum(2))
        assert (np.abs(model.distances(q, c, code[own]) - true) <= error[own] + 1e-9).all()
    assert len(nearest.k_means(np.ones((3, 2)), 8)) == 3


def test_containment_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    docs = [(k, word(rng.randrange(40))) for k in range(150)] + [(900, None), (901, ""), (902, "a" * 5000), (902, "a" * 5000)]
    names = [(k, word(rng.randrange(1, 5))) for k in range(60)] + [(70, None), (71, ""), (72, "aa"), (73, "aa"), (74, "a" * 300)]
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "query_id long, name string")
    pairs = lambda ok: sorted((q, k) for k, t in docs for q, x in names if t is not None and x is not None and ok(t, x))
    for size in (containment.BLOCK_CHARS, 40):
        monkeypatch.setattr(containment, "BLOCK_CHARS", size)
        assert _rows(containment.holding(d, n)) == sorted(pairs(lambda t, x: x in t), key=repr)
        assert _rows(containment.holding(d, n, at_start=True)) == sorted(pairs(lambda t, x: t.startswith(x)), key=repr)
        assert _rows(containment.held(d, n)) == sorted(pairs(lambda t, x: t in x), key=repr)
    monkeypatch.setattr(containment, "ahocorasick", None)
    assert _rows(containment.holding(d, n)) == sorted(pairs(lambda t, x: x in t), key=repr)
    for f in (containment.holding, containment.held):
        assert f(d, n.limit(0)).columns == ["query_id", "doc_id"] and f(d, n.limit(0)).count() == f(d.limit(0), n).count() == 0


def test_containment_time_does_not_grow_with_names(spark):
    """A suffix array and an automaton of 20 times the names read the same documents."""
    assert inverted.WINDOW > 1
    names = [f"n{k}x" for k in range(20_000)]
    s = containment.Suffixes(names)
    assert [s.texts[k] for k in s.holding("n77x")] == ["n77x"] and len(s.holding("x")) == 20_000 and s.holding("y") == []
    assert containment.Suffixes([]).holding("a") == [] and containment.Suffixes(["", "b"]).holding("") == [0, 1]


def test_a_search_writes_nothing(spark, tmp_path, monkeypatch):
    """What is handed on is a task's best of each query, and nothing is staged: no row for each query and cell (findings 1 and 4)."""
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(1500)] + [(2000 + k, [1.0] * 16) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = docs.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    index = VectorIndex(spark, f"{tmp_path}/v").build(docs, 30, parts=4)
    monkeypatch.setattr(nearest, "staged", None)
    got = index.search(asked, 5, probes=1 << 30)
    assert _rows(got.select("query_id", "doc_id", "rank")) == _rows(retrieval.dense(asked, docs, 5).select("query_id", "doc_id", "rank"))
    assert [r.doc_id for r in got.filter("query_id = 2035").orderBy("rank").collect()] == [2000, 2001, 2002, 2003, 2004]


def test_documents_of_terms_are_counted_exactly(spark, monkeypatch):
    """Terms and documents as one number, in tasks that hand on what they hold again and again (findings 8, 10, 13, 15 to 19)."""
    texts = ["a ab abc abcd", "한글 문서 한글", "", "𝒳y 𐐷𐐷 a", "abcd abcde x", "ab " * 5] * 40
    for some in (texts, [chr(0x10000 + 7 * k) + "z" for k in range(300)]):
        doc, code, long_words = retrieval.term_codes(some)
        every, df = retrieval.document_counts(doc, code, len(some))
        want = {}
        for d, c in set(zip(doc.tolist(), code.tolist(), strict=True)):
            want[c] = want.get(c, 0) + 1
        assert dict(zip(every.tolist(), df.tolist(), strict=True)) == want and len(every) == len(want)
    assert retrieval.spelled(np.array([97, (97 << 21) | 98, (0x1D4B3 << 42) | (98 << 21) | 99]), pa.array([], pa.large_string())).to_pylist() == ["a", "ab", "𝒳bc"]
    monkeypatch.setattr(retrieval, "HELD", 5)
    monkeypatch.setattr(retrieval, "DOC_ROWS", 7)
    n, mean, df = retrieval.term_statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert n == 240 and {r.term: r.df for r in df.collect()}["ab"] == 120 and abs(mean * n - sum(len(retrieval.term_codes([t])[1]) for t in texts)) < 1e-6


def test_bounds_are_taken_from_postings_where_they_lie(spark, tmp_path, monkeypatch):
    plans, write = {}, InvertedIndex._write

    def watched(self, df, name, *by):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        write(self, df, name, *by)

    monkeypatch.setattr(InvertedIndex, "_write", watched)
    index = InvertedIndex(spark, f"file://{tmp_path}/index", grams=())
    index.add(spark.createDataFrame([(k, f"common word{k % 5} x{k}") for k in range(100)], "doc_id long, text string"))
    assert "RepartitionByExpression" in plans["postings"] and "RepartitionByExpression" not in plans["bounds"]
    assert index._read("bounds").agg({"n": "sum"}).first()[0] == 300


def test_index_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Round 4, finding 2: tables of past steps and shuffles stayed, and postings were moved to meet deleted documents."""
    docs, asked = spark.createDataFrame(_corpus(spark, 200), "doc_id long, text string"), spark.createDataFrame([(k, f"w{k} w1 w2") for k in range(9)], "query_id long, text string")
    monkeypatch.setattr(inverted, "QUERIES", 5)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    index = InvertedIndex(spark, f"{tmp_path}/ix", grams=(), buckets=8)
    index.add(docs.filter("doc_id < 100").withColumn("text", F.reverse("text")))
    index.add(docs)
    assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) == before
    got = index.search(asked, 3)
    left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert left and all(x.endswith("-scores") for x in left)
    assert _rows(got) == _rows(retrieval.bm25(asked, docs, 3, grams=()))
    # a window's deleted documents are found in its row where many are gone, too
    monkeypatch.setattr(inverted, "GONE_WINDOWS", 0)
    assert index.delete(spark.createDataFrame([(7,), (8,), (150,)], "doc_id long")) == 3
    assert _rows(index.search(asked, 3)) == _rows(retrieval.bm25(asked, docs.filter("doc_id not in (7, 8, 150)"), 3, grams=()))
