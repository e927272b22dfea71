"""A crawl that is stopped, dies and goes on; hosts that are asked politely."""

import collections

import pytest
from pyspark.sql import functions as F

from lectern.operators import crawl
from lectern.operators.crawl import Crawl
from lectern.sources import readers

LINKS = {0: [1, 2, 3], 1: [2, 4, 4], 2: [0, 5], 3: [], 4: [6], 5: [6, 7], 6: [1], 7: [8], 8: [], 9: [0]}
URL = "http://h{}/p{}"


def _url(k):
    return URL.format(k % 3, k)


@pytest.fixture
def web(spark):
    """(fetch, links, log): pages by number; ``log`` gets what is fetched, and from ``broken`` their first answers."""
    log, broken = [], collections.defaultdict(list)
    known = {_url(k): " ".join(map(_url, v)) for k, v in LINKS.items()}

    def fetch(urls):
        rows = []
        for r in urls.collect():
            log.append(r.url)
            status = broken[r.url].pop(0) if broken[r.url] else 200
            rows.append((r.url, status, known[r.url] if status == 200 else None))
        return spark.createDataFrame(rows, "url string, status int, content string")

    def links(got):
        return got.select("url", F.explode(F.split("content", " ")).alias("dst"))

    return fetch, links, log, broken


def _state(c):
    return {r.url: (r.depth, r.state, r.attempts) for r in c.state().collect()}


def test_stopped_and_started_again(spark, tmp_path, web):
    fetch, links, log, _ = web
    seeds = spark.createDataFrame([(_url(0),), (_url(0),), (None,), ("",)], "url string")
    one = Crawl(spark, f"{tmp_path}/c", fetch, links, per_host=2, buckets=4)
    assert one.state().count() == 0
    one.seed(seeds)
    assert one.run(rounds=2) == 4 and 0 < len(log) < 9
    again = Crawl(spark, f"{tmp_path}/c", fetch, links, per_host=2, buckets=4)
    again.seed(seeds)  # known by now
    again.run()
    assert sorted(log) == sorted(map(_url, range(9)))  # each once; nothing leads to 9
    want = {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4}
    assert _state(again) == {_url(k): (d, "done", 1) for k, d in want.items()}
    shallow = Crawl(spark, f"{tmp_path}/d", fetch, links, depth=1, buckets=4)
    shallow.seed(seeds)
    assert shallow.run(most=3) == 3 and shallow.run() == 1 and len(_state(shallow)) == 4


def test_leases_and_errors(spark, tmp_path, web):
    fetch, links, log, broken = web
    at = [1000.0]
    c = Crawl(spark, f"{tmp_path}/c", fetch, links, lease=50, attempts=2, pause=10, buckets=2)
    c.seed(spark.createDataFrame([(_url(7),)], "url string"))
    c.claim(at[0])  # and dead
    assert c.step(at[0] + 49) == 0 and c.step(at[0] + 50) == 1 and _state(c)[_url(7)] == (0, "done", 2)
    broken[_url(8)] = [503, 500]
    assert c.step(1100) == 1 and _state(c)[_url(8)] == (1, "queued", 1)
    assert c.step(1105) == 0 and c.step(1110) == 1 and _state(c)[_url(8)] == (1, "failed", 2) and c.step(9999) == 0
    # dead after the links are queued and before the page is noted: fetched again, no link lost
    d = Crawl(spark, f"{tmp_path}/d", fetch, links, lease=50, buckets=2)
    d.seed(spark.createDataFrame([(_url(1),)], "url string"))
    upsert, calls = d.table.upsert, []

    def dies(rows, expected=None):
        calls.append(rows)
        return upsert(rows, expected) if len(calls) < 3 else 1 / 0

    d.table.upsert = dies
    with pytest.raises(ZeroDivisionError):
        d.step(0)
    d.table.upsert = upsert
    assert _state(d)[_url(1)][1] == "inflight" and _state(d)[_url(4)] == (1, "queued", 0)
    broken[_url(4)] = [404]
    d.run(clock=lambda: 60.0)
    assert {s for _, s, _ in _state(d).values()} == {"done", "failed"} and _state(d)[_url(4)][1] == "failed"


def test_hosts_are_asked_politely(spark):
    rows = [(f"http://h{k % 3}/p{k}", f"h{k % 3}") for k in range(12)] + [("http://h0/shut/1", "h0")]
    urls = spark.createDataFrame(rows, "url string, host string").repartition(3)
    texts = spark.createDataFrame([("h0", "User-agent: *\nDisallow: /shut\nCrawl-delay: 0.2")], "host string, text string")

    def opener(url):
        if url.endswith("p4"):
            raise OSError("gone")
        return (200, {}, url.encode()) if not url.endswith("p5") else (500, {}, b"")

    got = crawl.politely(opener, readers.robots(spark, texts), "us", pause=0.05)(urls).collect()
    assert {r.url: r.status for r in got} == {u: 403 if "shut" in u else None if u.endswith("p4") else 500 if u.endswith("p5") else 200 for u, _ in rows}
    for h, least in (("h0", 0.2), ("h1", 0.05), ("h2", 0.05)):
        at = [r.at for r in sorted(got, key=lambda r: r.url) if f"//{h}/" in r.url and r.at]
        assert len(at) == 4 and sorted(at)[0] > 0 and min(b - a for a, b in zip(sorted(at), sorted(at)[1:], strict=False)) >= least
