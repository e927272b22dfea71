"""Keyed tables: keep-first, latest-wins, incremental anti-joins, upserts, rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``. min_by aggregates before it shuffles, so a popular key is no burden."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: what an append-only log or repeated upserts come to."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same keys."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["__v"]).drop("__v")


def changed(chunks: DataFrame, log: DataFrame, key: str = "chunk_id", content: str = "text", seq: str = "seq") -> DataFrame:
    """Chunks that are new or whose content hash is not the last one logged."""
    last = latest(log, [key], [seq]).select(key, "content_hash")
    return chunks.withColumn("content_hash", F.md5(content)).join(last, [key, "content_hash"], "left_anti")


def stale(log: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Logged chunks that no longer exist, because their document shrank or went."""
    return log.select(key).distinct().join(chunks.select(key), key, "left_anti")


def first_rule(text: Column, rules: list[tuple[str, list[str]]], otherwise) -> Column:
    """The name of the first rule of which ``text`` contains a keyword."""
    out = None
    for name, keywords in rules:
        hit = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(otherwise)


#: A rule table is written by hand; one that is longer is none.
RULES = 10_000


def route(queries: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Sites of the rules of which a keyword occurs and no excluded keyword does. The rule table is counted before it is broadcast."""
    if rules.count() > RULES:
        raise ValueError(f"more than {RULES} rules")
    hit = F.exists("keywords_any", lambda k: F.contains(F.col(text), k)) & ~F.exists("exclude_keywords_any", lambda k: F.contains(F.col(text), k))
    return queries.join(F.broadcast(rules), hit, "inner")


def early_stop(links: DataFrame, board: str, position: str, seen: str, run: int = 5) -> DataFrame:
    """Rows of each board before the first run of ``run`` that were seen already."""
    w = Window.partitionBy(board).orderBy(position)
    df = links.withColumn("__g", F.sum((~F.col(seen)).cast("int")).over(w))
    df = df.withColumn("__n", F.sum(F.col(seen).cast("int")).over(Window.partitionBy(board, "__g").orderBy(position)))
    df = df.withColumn("__stop", F.max((F.col("__n") >= run).cast("int")).over(w))
    return df.filter("__stop = 0").drop("__g", "__n", "__stop")


def put_blobs(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, sha, object, action): equal content under its name is skipped; another content gets the name with its digest."""
    old = catalog.select("name", F.col("sha").alias("old"))
    met = new.join(old, "name", "left")
    action = F.when(F.col("old") == F.col("sha"), "skip").when(F.col("old").isNull(), "put").otherwise("rename")
    suffix = F.concat(F.lit("_"), F.left("sha", F.lit(8)))
    return met.select("name", "sha", F.when(action == "rename", F.regexp_replace("name", r"(\.[^.]*)?$", "")).otherwise(F.col("name")).alias("stem"), action.alias("action"), suffix.alias("suffix"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("ext")).select(
        "name", "sha", F.when(F.col("action") == "rename", F.concat("stem", "suffix", "ext")).otherwise(F.col("name")).alias("object"), "action"
    )


def union_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All rows by name, of each key that of the first frame that has it, by ``order`` within a frame."""
    out = frames[0].withColumn("__f", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("__f", F.lit(k)), allowMissingColumns=True)
    return keep_first(out, keys, ["__f", *order]).drop("__f")


def repeated_blobs(catalog: DataFrame, key: str = "original_filename", name: str = "name") -> DataFrame:
    """Objects to delete: all but the first by name of those with the same original name. Those without one stay."""
    known = catalog.filter(F.col(key).isNotNull())
    return known.join(known.groupBy(key).agg(F.min(name).alias("__first")), key).filter(F.col(name) != F.col("__first")).drop("__first")


def documents_of_chunks(docs: DataFrame, chunk_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents to which any of the chunks belongs: a chunk's id without its last part."""
    return docs.join(chunk_ids.select(F.regexp_replace("chunk_id", "_[^_]*$", "").alias(key)).distinct(), key, "left_semi")


# state between runs ------------------------------------------------------------------------------------------------------


def above_mark(links: DataFrame, state: DataFrame, most: int = 30, keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """(new, state): links (board, pos, url, number) with a number above the largest that the board's state (board, latest_ids) has, the
    first ``most`` of them; and the state after, the largest ``keep`` of its numbers and those of the first ``keep`` links. A board's
    list is one page of links."""
    met = links.join(state, "board", "left")
    top = F.coalesce(F.array_max("latest_ids"), F.lit(0))
    w = Window.partitionBy("board").orderBy("pos")
    new = met.filter(F.col("number") > top).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).select(*links.columns)
    first = links.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).groupBy("board").agg(F.collect_set("number").alias("ids"))
    none = F.array().cast("array<bigint>")
    after = state.join(first, "board", "full_outer").select("board", F.slice(F.sort_array(F.array_distinct(F.concat(F.coalesce("latest_ids", none), F.coalesce("ids", none))), False), 1, keep).alias("latest_ids"))
    return new, after


def unseen_rows(rows: DataFrame, state: DataFrame, keep: int = 200) -> tuple[DataFrame, DataFrame]:
    """(new, state): rows (target, pos, key) whose key the target's state (target, seen) lacks; and the state after, the newest ``keep``
    keys, those of this run first."""
    none = F.array().cast("array<string>")
    met = rows.join(state, "target", "left")
    new = met.filter(~F.coalesce(F.array_contains("seen", F.col("key")), F.lit(False))).select(*rows.columns)
    # no more than the newest ``keep`` of a run can be in the state after it
    newest = rows.groupBy("target", "key").agg(F.min("pos").alias("pos")).withColumn("__n", F.row_number().over(Window.partitionBy("target").orderBy("pos", "key"))).filter(F.col("__n") <= keep)
    batch = newest.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda r: r["key"]).alias("b"))
    after = state.join(batch, "target", "full_outer").select("target", F.slice(F.array_distinct(F.concat(F.coalesce("b", none), F.coalesce("seen", none))), 1, keep).alias("seen"))
    return new, after


def due(targets: DataFrame, last: DataFrame, today: Column, forced: list[str] = ()) -> DataFrame:
    """Targets (name) that were not fetched today (``last``: name, fetched_at), and those that are forced."""
    met = targets.join(last.groupBy("name").agg(F.max("fetched_at").alias("__at")), "name", "left")
    return met.filter(F.col("__at").isNull() | (F.to_date("__at") < today) | F.col("name").isin(*forced)).drop("__at")


def changed_first(first: DataFrame, state: DataFrame) -> DataFrame:
    """Boards (board, first) whose first row is there and is not the one of the last run (board, last)."""
    return first.join(state, "board", "left").filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("last"))).select("board", "first")


def resumed(queue: DataFrame, inflight: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """A crawl's queue (url, pos) after a crash: what was being fetched comes first, nothing that was done, each once."""
    front = inflight.select(key, F.lit(-1).cast("long").alias("pos"))
    return front.unionByName(queue.select(key, F.col("pos").cast("long").alias("pos"))).groupBy(key).agg(F.min("pos").alias("pos")).join(done.select(key), key, "left_anti")


def first_queries(lists: list[DataFrame], n: int = 100, text: str = "query") -> DataFrame:
    """The first ``n`` different questions of several lists (query, pos), in the order of the lists."""
    out = None
    for k, df in enumerate(lists):
        part = df.select(text, F.lit(k).alias("list"), "pos")
        out = part if out is None else out.unionByName(part)
    one = out.groupBy(text).agg(F.min(F.struct("list", "pos")).alias("at"))
    return one.orderBy("at").limit(n).select(text, F.col("at.list").alias("list"), F.col("at.pos").alias("pos"))


def seed_order(urls: DataFrame, n: int, url: str = "loc", lastmod: str = "lastmod") -> DataFrame:
    """The first ``n`` addresses of a crawl: newest first, those without a date last, ties by address."""
    return urls.orderBy(F.coalesce(lastmod, F.lit("")).desc(), F.col(url)).limit(n)


def latest_post(links: DataFrame) -> DataFrame:
    """(board, url): the first link of each board's list."""
    return links.groupBy("board").agg(F.min_by("url", "pos").alias("url"))
