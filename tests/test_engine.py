"""The engine's queries against DuckDB, and its functions against hand-made cases."""

import datetime
import json
import os
import random
import uuid
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import models, urls
from lectern.functions import text as tx
from lectern.operators import chunking, documents, evaluation, html, intents, pages, retrieval, tables
from lectern.sources import readers, writers
from lectern.streaming import incremental

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df: pd.DataFrame) -> list:
    one = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else round(float(x), 5) if hasattr(x, "real") and not isinstance(x, bool) else str(x)
    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 1100, 1850, 2600, 5000])
def test_windows(n):
    r = random.Random(n)
    t = "".join(r.choice("abc .") for _ in range(n))
    spans = chunking.windows(t)
    covered = set().union(*[range(a, b) for a, b in spans]) if spans else set()
    assert all(b - a <= 1000 for a, b in spans) and all(t[i].isspace() for i in set(range(n)) - covered)
    assert all(y[0] == (x[0] + 850 if x[1] == n else x[1] - 150) for x, y in zip(spans, spans[1:]))  # a last window that overshoots by less than the overlap leaves a tail
    long = chunking.stretched(t)
    assert all(b - a <= 1000 for a, b in long) and (not long or long[-1][1] == n)


def test_recursive():
    assert chunking.recursive("aa bb cc dd", 5, 2) == ["aa bb", "cc", "dd"]  # the blank before a word counts
    assert chunking.recursive("para one\n\npara two", 10, 0) == ["para one", "para two"]
    assert chunking.recursive("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.recursive("", 10, 0) == []


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a. " * 600), (2, None), (3, " ")], "doc_id long, text string")
    got = chunking.chunk(df).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in got] == ["1__0", "1__1", "1__2"] and got[0].total_chunks == 3
    assert _one(spark, chunking.with_header(F.col("t"), {"title": F.col("a"), "url": F.lit(None).cast("string")}), t="body", a="T") == "title: T\n\nbody"


def test_post_cleaner(spark):
    post = "제목\n작성자\n홍\n조회\n5\n작성일\n2025.01.05\n본문 내용이 여기에 있습니다\n\n[표 데이터 시작]칸[표 데이터 끝]\n이전글 무엇\n뒤"
    assert _one(spark, tx.clean_post("t"), t=post) == "2025.01.05\n본문 내용이 여기에 있습니다\n칸"
    short = "목록 " + "x" * 60
    assert _one(spark, tx.clean_post("t"), t=short) == short
    assert _one(spark, tx.clean_lines("t"), t="Copyright x\n 12 \n- 3 -\nreal  line\n\nnext") == "real line next"
    assert _one(spark, tx.clean_corpus("t"), t=" a  목록으로 b\tHOME › c ") == "a b c"
    assert _one(spark, tx.ngram_tokens("t"), t="Ab, cde") == ["ab", "cde", "ab", "cd", "de", "cde"]
    assert _one(spark, tx.parse_fenced_json("t", "a string"), t='```json\n{"a": "b"}\n```').a == "b"


def test_joins_of_archives(spark):
    members = spark.createDataFrame([("z.zip", "d/a.txt"), ("y.zip", "b.txt")], "archive string, member string")
    on = spark.createDataFrame([("z.zip", "u1"), ("z.zip", "u2")], "archive string, url string")
    assert sorted(r.url for r in documents.members_on_pages(members, on).collect()) == ["u1", "u2"]
    names = spark.createDataFrame([("a.txt", "old", 1), ("a.txt", "new", 2)], "name string, url string, seq long")
    assert [(r.member, r.url) for r in documents.members_by_name(members, names).collect()] == [("d/a.txt", "new")]
    chunks = spark.createDataFrame([("c", "d", "t", "f.pdf")], "chunk_id string, doc_id string, text string, file_name string")
    p = documents.with_payload(chunks).first().payload
    assert len(p) == 13 and p.file_name == "f.pdf" and p.site is None
    page = html.minimal_page(F.col("u"), F.lit("T"), F.lit("<p>x</p>"), F.lit("now"))
    assert _one(spark, page, u="http://h/").count("http://h/") == 3
    assert _one(spark, tx.schedule_lines("t", "intro"), t="a\n 3.2 day\n\nb 12/31") == "intro\n일정 정보: 3.2 day\n일정 정보: b 12/31" and _one(spark, tx.schedule_lines("t", "intro"), t="a") == "a"
    info = documents.page_info(spark.createDataFrame([("u", "t", "text", "now", ["a"])], "url string, title string, text string, crawled_at string, attachments array<string>")).first()
    assert (info.text_length, info.attachments_count) == (4, 1)


def test_document_names(spark):
    assert _one(spark, tx.base_document_name("t"), t="Guide.pdf_chunk12") == "Guide"
    assert _one(spark, tx.same_document("a", "b"), a="x_chunk1", b="x_chunk12") and not _one(spark, tx.same_document("a", "b"), a="x_chunk1", b="y_chunk1")


def test_urls(spark):
    u = "https://www.site.ac.kr/board/notice.do?mode=view&articleNo=77&article.offset=10#top"
    assert _one(spark, urls.doc_id("u"), u=u) == "www_notice_77"
    assert _one(spark, urls.doc_id("u"), u="https://a.b/c/d?page=3") == "a_d_p3" and _one(spark, urls.doc_id("u"), u="https://a.b/") == "a_index"
    assert _one(spark, urls.normalize("u"), u=u) == "https://www.site.ac.kr/board/notice.do?articleNo=77&mode=view"
    assert _one(spark, urls.clean("u"), u="http://h/p?b=1&x=&article.offset=3&a=2") == "http://h/p?b=1&a=2"
    assert _one(spark, urls.uuid5("u"), u=u) == str(uuid.uuid5(uuid.NAMESPACE_URL, u))
    dates = [("2025.1.5", datetime.date(2025, 1, 5)), ("2025-01-05T10:00:00", datetime.date(2025, 1, 5)), ("2025.01.05.", None), ("x", None)]
    assert all(_one(spark, urls.best_date("d"), d=a) == b for a, b in dates)
    assert _one(spark, pages.recent(F.col("d"), "2021-01-01"), d="2020-12-31") is False and _one(spark, pages.recent(F.col("d"), "2021-01-01"), d="?") is True


def test_intents(spark):
    assert _one(spark, intents.classify(F.col("q")), q="셔틀버스 시간") == "bus" and _one(spark, intents.classify(F.col("q")), q="오늘 학식") == "menu"
    assert _one(spark, intents.classify(F.col("q")), q="this") == "chitchat" and _one(spark, intents.classify(F.col("q")), q="무엇") == "general"
    assert _one(spark, intents.alert(F.col("q")), q="국가장학금 안내") == "SCHOLARSHIP" and _one(spark, intents.refuses(F.col("q")), q="정보가 없습니다.") is True
    row = {"site": "", "board_name": "학사일정", "title": None, "source_type": "schedule", "url": ""}
    assert _one(spark, intents.boost(F.lit(0.5), F.lit("schedule")), **row) == pytest.approx(0.85)
    rules = spark.createDataFrame(intents.ROUTES, "site string, site_key string, keywords_any array<string>, exclude_keywords_any array<string>")
    q = spark.createDataFrame([("통학버스 시간",), ("통학버스 학사일정",), ("등록금",)], "text string")
    assert sorted((r.text, r.site_key) for r in tables.route(q, rules).collect()) == [("등록금", "main"), ("통학버스 시간", "bus")]


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, "a e")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(q, docs, 3, grams=()).collect()}
    assert got[1] > got[2] > 0 or got[1] > max(got[2], got[3])  # "a" is in every document: its negative idf is replaced
    assert {r.doc_id: r.score for r in retrieval.bm25(q, docs, 3, grams=(), normalised=True).collect()}[1] == 1.0
    assert retrieval.bm25(q.limit(0), docs, 3).count() == retrieval.bm25(q, docs.limit(0), 3).count() == 0
    hits = spark.createDataFrame([(1, 1, 0.3, 1), (1, 2, 0.2, 2), (2, 1, 0.5, 1), (2, 3, 0.1, 2)], "query_id long, doc_id long, score double, rank int")
    assert {r.query_id for r in retrieval.drop_below(hits).collect()} == {2}
    one = spark.createDataFrame([(1, 3.0, 3.0, 1)], "query_id long, lo double, hi double, n long")
    assert retrieval.min_max(spark.createDataFrame([(1, 1, 3.0)], "query_id long, doc_id long, score double"), one, 1).first().score == 1.0
    text = retrieval.context(hits.withColumn("text", F.when(F.col("doc_id") == 1, " ").otherwise("t"))).filter("query_id = 1").first().context
    assert text == "[2] t"
    again = retrieval.rerank(hits.withColumn("query", F.lit("t")).withColumn("text", F.col("doc_id").cast("string")), lambda q, t: t.cast("double"), 1)
    assert {(r.query_id, r.doc_id) for r in again.collect()} == {(1, 2), (2, 3)}
    truth = spark.createDataFrame([(1, 2), (2, 9)], "query_id long, doc_id long")
    m = evaluation.recall_and_mrr(hits, truth).first()
    assert (m.recall_1, m.recall_3, m.mrr) == (0.0, 0.5, 0.25)


@pytest.mark.parametrize("grams", [(), (2, 3), (3,)])
def test_terms_are_those_of_the_columns(spark, grams):
    texts = ["a bb ccc dddd ab", "", "x", "Ünï côdé 漢字かな 한국어 a", "longer words in here longer", "\U0001f600\U0001f600 \U0001f600"]
    doc, code, words = retrieval.term_codes(texts, grams)
    spelled = retrieval.spelled(code, words).to_pylist()
    for k, t in enumerate(texts):
        want = list(t.split()) + [w[i : i + n] for w in t.split() for n in grams for i in range(len(w) - n + 1)]
        assert sorted(x for x, d in zip(spelled, doc.tolist(), strict=True) if d == k) == sorted(want)
    if grams == (2, 3):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.ngram_tokens("t").alias("x")).collect()
        plain = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_join(tx.tokens("t"), " ").alias("x")).collect()
        doc, code, words = retrieval.term_codes([r.x for r in plain], grams)
        spelled = retrieval.spelled(code, words).to_pylist()
        assert [sorted(r.x) for r in got] == [sorted(x for x, d in zip(spelled, doc.tolist(), strict=True) if d == k) for k in range(len(texts))]


def test_blocks_of_queries(spark, monkeypatch):
    """Many small tables of weights give the hits of one."""
    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet").selectExpr("item_id AS query_id", "text").limit(6)
    want = sorted(map(tuple, retrieval.bm25(items, docs, 4, digits=6).collect()))
    monkeypatch.setattr(retrieval, "TABLE", 1000)
    monkeypatch.setattr(retrieval, "DOC_ROWS", 7)
    assert sorted(map(tuple, retrieval.bm25(items, docs, 4, digits=6).collect())) == want and len(want) == 24


def test_dense_without_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8]), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    assert [(r.doc_id, round(r.score, 6)) for r in retrieval.dense(q, docs, 4).orderBy("rank").collect()] == [(1, 1.0), (5, 1.0), (3, 0.6), (4, 0.0)]
    with pytest.raises(Exception, match="does not have 2 numbers"):
        retrieval.dense(q, docs.unionByName(spark.createDataFrame([(9, [1.0])], "doc_id long, vector array<float>")), 4).collect()
    assert retrieval.dense(q.filter("query_id = 2"), docs, 4).count() == 0


def test_models_are_loaded_once_a_worker(spark):
    def load():
        calls = []

        def model(*columns):
            calls.append(1)
            return [f"{len(calls)}:{'+'.join(map(str, x))}" for x in zip(*columns, strict=True)]

        return model

    df = spark.range(3).select(F.col("id").cast("string").alias("a"), F.lit("u").alias("b"))
    assert sorted(r[0] for r in df.coalesce(1).select(models.generator(load)("a", "b")).collect()) == ["1:0+u", "1:1+u", "1:2+u"]
    assert [r[0] for r in df.select(models.scorer(lambda: lambda a, b: [float(x) for x in a])("a", "b")).collect()] == [0.0, 1.0, 2.0]
    assert [r[0] for r in df.select(models.embedder(lambda: lambda a: [[float(x), 1.0] for x in a])("a")).collect()][2] == [2.0, 1.0]


def test_fetching(spark):
    """Errors that pass are asked again, others not; what the cache has is not asked for."""

    def opener(url):
        state = opener.__dict__.setdefault("asked", {})
        state[url] = state.get(url, 0) + 1
        if url == "http://h/slow" and state[url] < 3:
            return 503, {}, b""
        if url == "http://h/none":
            raise OSError("no route")
        kind = {"http://h/pdf": "application/pdf"}.get(url, "text/html; charset=utf-8")
        return (404 if url == "http://h/404" else 200), {"content-type": kind, "content-disposition": 'attachment; filename="n.html"' if "named" in url else ""}, b"body"

    asked = spark.createDataFrame([(f"http://h/{x}",) for x in ("a.html", "a.html", "slow", "none", "pdf", "404", "named", "kept")], "url string").coalesce(1)
    cache = spark.createDataFrame([("http://h/kept", b"old"), ("http://h/other", b"x")], "url string, content binary")
    got = {r.url.rsplit("/", 1)[1]: r for r in readers.fetch(asked, opener, cache).collect()}
    assert len(got) == 7 and bytes(got["slow"].content) == b"body" and bytes(got["kept"].content) == b"old" and got["named"].name == "n.html" and got["a.html"].name == "a.html"
    assert got["none"].error == "OSError: no route" and got["404"].status == 404 and got["404"].content is None and got["pdf"].content is None


def test_early_stop(spark):
    rows = [(1, i, i >= 3) for i in range(10)] + [(2, i, i % 2 == 0) for i in range(10)]
    got = tables.early_stop(spark.createDataFrame(rows, "b long, p long, s boolean"), "b", "p", "s").collect()
    assert sorted(r.p for r in got if r.b == 1) == list(range(7)) and len([r for r in got if r.b == 2]) == 10


def test_frontier(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = pages.frontier(e, spark.createDataFrame([("a",)], "node string"), 5).collect()
    assert {(r.node, r.depth) for r in got} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    os.makedirs(f"{p}/raw/x")
    att = {"page_url": "u", "filename": "f"}
    for k, page in enumerate([{"doc_id": "1", "main_text": "m", "attachments": []}, {"doc_id": "2", "text": "t", "metadata": {"attachments": [att]}}]):
        with open(f"{p}/raw/x/{k}.json", "w") as f:
            json.dump(page, f, indent=1)
    with open(f"{p}/raw/bad.json", "w") as f:
        f.write("{ no")
    raw = readers.json_pages(spark, f"{p}/raw").cache()
    assert raw.filter("_corrupt_record is not null").count() == 1
    assert {(r.doc_id, r.main_text, len(r.attachments or [])) for r in raw.filter("doc_id is not null").collect()} == {("1", "m", 0), ("2", "t", 1)}
    with open(f"{p}/map.xml", "w") as f:
        f.write("<urlset><url><loc> http://a/b/ </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a/b</loc><lastmod>2024-02-01</lastmod></url></urlset>")
    assert [tuple(r) for r in readers.sitemap(spark, f"{p}/map.xml").collect()] == [("https://a/b", "2024-02-01")]
    with open(f"{p}/c.csv", "w") as f:
        f.write('http://x,t,"a",b,c\nnot an address\n')
    assert readers.headerless_csv(spark, f"{p}/c.csv", ["url", "title", "rest"]).first().rest == '"a",b,c'
    with zipfile.ZipFile(f"{p}/z.zip", "w") as z:
        z.writestr("d/a.txt", "hi")
        z.writestr("__MACOSX/a.txt", "no")
    assert [(r.member, bytes(r.content)) for r in readers.zip_members(readers.files(spark, f"{p}/z.zip", ("zip",))).collect()] == [("d/a.txt", b"hi")]
    with open(f"{p}/q.txt", "w") as f:
        f.write("one\n\n two \n")
    assert sorted(r.text for r in readers.lines(spark, f"{p}/q.txt").collect()) == ["one", "two"]
    assert [(r.query_id, r.text) for r in readers.lines(spark, f"{p}/q.txt").orderBy("query_id").collect()] == [(0, "one"), (1, "two")]
    with open(f"{p}/bad.zip", "wb") as f:
        f.write(b"PK no archive")
    broken = readers.zip_members(readers.files(spark, f"{p}/*.zip", ("zip",))).collect()
    assert sorted((r.member or "", r.error is None) for r in broken) == [("", False), ("d/a.txt", True)]
    with open(f"{p}/index.xml", "w") as f:
        f.write("<sitemapindex><sitemap><loc> http://h/ko/map.xml </loc></sitemap><sitemap><loc>http://h/en/map.xml</loc></sitemap><sitemap><loc>http://h/ko/index.xml</loc></sitemap></sitemapindex>")
    where = {"http://h/index.xml": f"{p}/index.xml", "http://h/ko/index.xml": f"{p}/index.xml", "http://h/ko/map.xml": f"{p}/map.xml"}
    assert [tuple(r) for r in readers.sitemaps(spark, "http://h/index.xml", where.__getitem__, ("ko",)).collect()] == [("https://a/b", "2024-02-01")]
    with open(f"{p}/named.csv", "w") as f:
        f.write('title,url\n"T, and",http://x\n')
    assert [tuple(r) for r in readers.crawl_csv(spark, f"{p}/named.csv", ["url", "title", "text"]).collect()] == [("http://x", "T, and", None)]
    assert readers.crawl_csv(spark, f"{p}/c.csv", ["url", "title", "text"]).first().title == "t"
    os.makedirs(f"{p}/chunks")
    for k, c in enumerate([{"chunk_id": "d__0", "text": "x", "metadata": {"tags": ["a"]}}, {"chunk_id": "d__1"}]):
        with open(f"{p}/chunks/{k}.json", "w") as f:
            json.dump(c, f)
    assert [(r.chunk_id, r.file) for r in readers.json_chunks(spark, f"{p}/chunks").orderBy("file").collect()] == [("d__0", "0.json"), ("d__1", "1.json")]
    for name, text in (("e.json", '[{"q": "a"}, {"q": "b"}]'), ("e.jsonl", '{"q": "a"}\n{"q": "b"}\n'), ("s.json", '{"delay": 1}')):
        with open(f"{p}/{name}", "w") as f:
            f.write(text)
    assert all(sorted(r.q for r in readers.json_sets(spark, f"{p}/{n}", "q string").collect()) == ["a", "b"] for n in ("e.json", "e.jsonl"))
    assert readers.settings(spark, f"{p}/s.json") == {"delay": 1} and readers.targets(spark, [{"name": "n", "url": "u"}]).first().kind == "board"
    corpus = spark.createDataFrame([("1", "u", 't"q', "line\nline", 0, 1, "s", "d", 0), ("2", "u", "t", " ", 0, 1, "s", "d", 0)], readers.CORPUS)
    writers.corpus_csv(corpus, f"{p}/corpus")
    assert [tuple(r) for r in readers.corpus_csv(spark, f"{p}/corpus").collect()] == [tuple(corpus.first())]
    writers.append_stamped(corpus.select("id"), f"{p}/log")
    writers.append_stamped(corpus.select("id"), f"{p}/log", F.lit("2025"))
    assert spark.read.option("header", True).csv(f"{p}/log").count() == 4
    v = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "id string, vector array<float>")
    writers.merge_vectors(spark, v, f"{p}/points", 3, 0)
    assert writers.merge_vectors(spark, v.unionByName(v.withColumn("id", F.lit("b"))), f"{p}/points", 3, 1).count() == 2
    korean = spark.createDataFrame([(bytearray("한글 문서".encode("cp949")),), (bytearray("한글".encode()),), (bytearray("\ufeffx".encode("utf-16-le")),), (bytearray(b"<meta charset=iso-8859-1>\xe9"),), (None,)], "c binary")
    assert [r[0] for r in korean.select(documents.decoded(F.col("c"))).collect()] == ["한글 문서", "한글", "x", "<meta charset=iso-8859-1>é", None]
    assert evaluation.markdown(spark.createDataFrame([("a", 0.123456), (None, None)], "m string, v double")).splitlines() == ["| m | v |", "|-|-|", "| a | 0.1235 |", "|  |  |"]
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    writers.merge(spark, a, f"{p}/t", ["k"], 0)
    out = writers.merge(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), f"{p}/t", ["k"], 1)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="does not have 3"):
        writers.vectors(spark.createDataFrame([([1.0, 2.0],)], "vector array<float>"), f"{p}/v", 3)


def test_stream_upserts(spark, tmp_path):
    seen = []
    incremental.upsert_batches(incremental.stream(spark, D, "benchmark"), lambda df, n: seen.append(df.count()), f"{tmp_path}/c")
    incremental.upsert_batches(incremental.stream(spark, D, "benchmark"), lambda df, n: seen.append(df.count()), f"{tmp_path}/c")
    assert sum(seen) == 40  # the second run finds nothing new


def test_pages_of_one_address(spark):
    """Known by its address, a page is taken once; known by its id, each page is one of its own, as in merged_crawls (finding 3)."""
    p = spark.createDataFrame([(0, "a", "1"), (1, "a", "2"), (2, "b", "2"), (3, "b", "1")], "page_id long, url string, crawled_at string").withColumns({"title": F.lit("t"), "text": F.lit("x")})
    seen = p.filter("page_id = 0")
    assert [(r.url, r.page_id) for r in documents.merged_pages(p, seen).collect()] == [("b", 3)]
    assert sorted(r.page_id for r in documents.merged_pages(p, seen, ("url", "page_id")).collect()) == [1, 2, 3]


def test_references_that_nothing_ends(spark):
    """A title that was cut within a reference (finding 5)."""
    page = "<title>a&amp;&lt;b&amp</title><script>x = 1 &amp y</script><p>c&ampd &amp; &#65 &#65;</p>"
    df = spark.createDataFrame([(page, "u"), (None, None)], "html string, url string")
    closed, read = (df.select(html.parts("html", "url", ("content", "quality"), closed).alias("p")).select("p.*").collect() for closed in (True, False))
    assert closed[0].content.title == "a&<b&amp" and closed[0].quality.text == "a&<b&amp c&ampd & &#65 A"
    assert read[0].content.title == "a&<b&" and read[0].quality.text == "a&<b& c&d & A A" and read[1].quality.text == ""


def test_slices_are_bounded(spark, monkeypatch):
    """Python sees a slice of a batch, whatever the batch's size; results are the same (findings 6, 7, 9)."""
    import pyarrow as pa

    from lectern.functions import slices

    long = pa.array(["x" * slices.BYTES, "y", None, *["z"] * 1000])
    cuts = [p[0] for p in slices.cut([long])]
    assert pa.concat_arrays(cuts).equals(long) and len(cuts[0]) == 1 and max(map(len, cuts)) <= slices.ROWS
    seen = slices.sliced(lambda a: [len(a)] * len(a), "int")
    rows = spark.range(3000).coalesce(1).select(seen(F.col("id")).alias("n")).collect()
    assert len(rows) == 3000 and max(r.n for r in rows) <= slices.ROWS


def test_lists_are_parsed_once_for_all_kinds(spark):
    plan = catalog.QUERIES["list_parsers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # a board's page and a calendar
