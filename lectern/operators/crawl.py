"""A crawl whose state outlives its process: a keyed table of addresses, and steps that each claim, fetch, and note what came of it.

An address is queued, in flight, done or failed. A step claims the next addresses of each host, at most ``per_host`` of them, for
``lease`` seconds; fetches them; queues the links that are new, one link further from the seeds; and then notes the results. Each of
these is one version of the table, so a process may die between any two: what was in flight is claimed again when its lease is over,
and a page is noted as done only when its links are queued. Without such a death each address is fetched once. Errors that may
pass are asked again after growing pauses, ``attempts`` times at most.

The state is partitioned by a hash of the address, and only the buckets that a step touches are written. The first ``per_host`` of a
host are cut before they are shuffled, so a host with a third of all addresses is no hot key.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.urls import host
from lectern.sources import readers
from lectern.sources.keyed import KeyedTable
from lectern.sources.shared import staged

STATE = "url string, host string, depth int, state string, attempts int, until double"
FETCHED = "url string, status int, content string, at double"


class Crawl:
    """``fetch``: (url, host) -> (url, status, content); ``links``: (url, content) -> (url, dst), addresses as they are to be
    fetched. ``depth``: the last distance from the seeds that is fetched, None for all."""

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], per_host: int = 100, lease: float = 600.0, attempts: int = 3, pause: float = 60.0, depth: int | None = None, buckets: int = 16):
        self.spark, self.fetch, self.links, self.per_host, self.lease, self.attempts, self.pause, self.depth = spark, fetch, links, per_host, lease, attempts, pause, depth
        self.table = KeyedTable(spark, path, ["url"], buckets)

    def state(self) -> DataFrame:
        return self.table.read() if self.table.version() else self.spark.createDataFrame([], STATE)

    def queue(self, urls: DataFrame) -> None:
        """Addresses (url, depth) that are not known yet."""
        new = urls.filter(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.min("depth").cast("int").alias("depth"))
        new = new if self.depth is None else new.filter(F.col("depth") <= self.depth)
        new = staged(new, "found")
        if self.table.version():
            new = staged(new.join(self.table.lookup(new.select("url")).select("url"), "url", "left_anti"), "new")
        own = F.coalesce(F.nullif(host("url"), F.lit("")), F.col("url"))
        self.table.upsert(new.select("url", own.alias("host"), "depth", F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.lit(0.0).alias("until")))

    def seed(self, urls: DataFrame) -> None:
        self.queue(urls.select("url", F.lit(0).alias("depth")))

    def claim(self, now: float, most: int | None = None) -> DataFrame:
        """The next addresses, in flight from now on: those least deep first, at most ``per_host`` of a host and ``most`` of all."""
        ready = self.state().filter(F.col("state").isin("queued", "inflight") & (F.col("until") <= now))
        place = F.row_number().over(Window.partitionBy("host").orderBy("depth", "url"))
        next_ = ready.withColumn("__n", place).filter(F.col("__n") <= self.per_host).drop("__n")
        next_ = next_ if most is None else next_.orderBy("depth", "url").limit(most)
        claimed = staged(next_.withColumns({"state": F.lit("inflight"), "attempts": F.col("attempts") + 1, "until": F.lit(now + self.lease)}), "claimed")
        self.table.upsert(claimed)
        return claimed

    def step(self, now: float | None = None, most: int | None = None) -> int:
        """Claim, fetch and note; returns how many addresses were claimed."""
        now = time.time() if now is None else now
        claimed = self.claim(now, most)
        n = claimed.count()
        if not n:
            return 0
        got = staged(self.fetch(claimed.select("url", "host")).select("url", "status", "content"), "fetched")
        found = self.links(got.filter("status = 200").select("url", "content"))
        self.queue(found.join(claimed.select("url", "depth"), "url").select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth")))
        passing = F.col("status").isNull() | F.col("status").isin(*readers.AGAIN)
        state = F.when(~passing, F.when(F.col("status") < 400, "done").otherwise("failed")).when(F.col("attempts") < self.attempts, "queued").otherwise("failed")
        until = F.when(state == "queued", F.lit(now) + self.pause * F.pow(F.lit(2.0), F.col("attempts") - 1)).otherwise(F.lit(0.0))
        once = got.groupBy("url").agg(F.max("status").alias("status"))
        self.table.upsert(claimed.join(once, "url", "left").select("url", "host", "depth", state.alias("state"), "attempts", until.alias("until")))
        return n

    def run(self, rounds: int | None = None, most: int | None = None, clock: Callable[[], float] = time.time) -> int:
        """Steps until nothing is ready, after ``rounds`` of them, or when ``most`` addresses were claimed; returns how many were."""
        total, k = 0, 0
        while rounds is None or k < rounds:
            left = None if most is None else most - total
            n = self.step(clock(), left) if left is None or left > 0 else 0
            if not n:
                break
            total, k = total + n, k + 1
        return total


def politely(opener=readers.open_url, rules: DataFrame | None = None, agent: str = "*", pause: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch``: one address of a host at a time, the robots file's delay or else ``pause`` seconds apart; what robots (``rules`` of
    ``readers.robots``) do not permit has status 403 and is not asked for. A host's addresses are fetched by one task, and
    tasks have many hosts: what one waits for, others use. Also gives ``at``, when each was asked for."""

    def fetch(urls: DataFrame) -> DataFrame:
        asked = urls.withColumns({"permitted": F.lit(True), "delay": F.lit(0.0)}) if rules is None else readers.permitted(urls, rules, agent)
        shut = asked.filter(~F.col("permitted")).select("url", F.lit(403).alias("status"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("double").alias("at"))
        n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def run(batches):
            import pyarrow as pa

            schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content", pa.string()), ("at", pa.float64())])
            waiting: dict[str, list] = {}
            for b in batches:
                for url, own, delay in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    waiting.setdefault(own, [delay or pause, 0.0, []])[2].append(url)
            while waiting:
                # the host that may be asked next
                own = min(waiting, key=lambda h: waiting[h][1])
                delay, ready, urls_ = waiting[own]
                time.sleep(max(0.0, ready - time.time()))
                url, at = urls_.pop(0), time.time()
                try:
                    status, _, body = opener(url)
                    row = {"url": url, "status": status, "content": body.decode("utf-8", "replace") if status == 200 else None, "at": at}
                except Exception:  # noqa: BLE001  whatever the network does is an error that may pass
                    row = {"url": url, "status": None, "content": None, "at": at}
                waiting[own][1] = time.time() + delay
                if not urls_:
                    del waiting[own]
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        open_ = asked.filter("permitted").select("url", "host", "delay").repartition(n, "host").sortWithinPartitions("host", "url")
        return open_.mapInArrow(run, FETCHED).unionByName(shut)

    return fetch
