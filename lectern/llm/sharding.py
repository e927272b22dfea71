"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group, which is never parted (a null text counts as an empty one). Groups stand in the order
of their smallest id. The operator cuts this sequence into ``n_shards`` contiguous runs so that the largest run is as
small as it can be: the smallest feasible capacity is found by binary search, each capacity being checked greedily.

The greedy check needs only prefix sums of the group sizes, which stay distributed. The driver holds a coarse table of
them (the ends of at most ``BLOCKS`` blocks) that gives every capacity a verdict of "feasible", "infeasible" or "not
known at this resolution". The blocks around the cuts that are still possible are then read at a finer resolution, until
the smallest feasible capacity is exact. What the driver holds depends on ``BLOCKS`` and ``n_shards`` alone.

Sums over the whole order come from range partitions: each is summed where it lies and only one row of totals a partition
meets on the driver, besides Spark's own sample of the order's columns, a hundred rows a partition. A group that holds a third of all rows is one row after partial aggregation, and its documents are
dealt by (group, id), so no task gets them all.

Texts of any length are digested whole, where they were read. Columns other than id and text are ignored. Null ids stand
first and are dealt like any other; repeated rows each get a slot of their own. With fewer groups than shards the last
shards stay empty. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.ordered import running, with_offsets
from lectern.llm.staging import materialize

BLOCKS = 4096


class _Known:
    """Some of the ends of groups (prefix sums), in order, and whether the next known one is the very next there is."""

    def __init__(self, ends: list[int], whole: list[bool]):
        self.ends, self.whole = ends, whole  # whole[k]: no unknown end lies between ends[k - 1] and ends[k]

    def cut(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end <= x: what is known, and what there could be."""
        k = bisect.bisect_right(self.ends, x)
        low = self.ends[k - 1] if k else 0
        return low, low if k == len(self.ends) or self.whole[k] else min(x, self.ends[k] - 1)


def _greedy(known: _Known, capacity: int, n: int, bound: int) -> list[int]:
    """The cuts, each as far as ``capacity`` lets it; bound 0 takes only known ends, bound 1 whatever there could be."""
    at, cuts = 0, []
    for _ in range(n):
        at = known.cut(at + capacity)[bound]
        cuts.append(at)
    return cuts


def minimax_capacity(known: _Known, total: int, n: int, low: int, high: int) -> tuple[int, int]:
    """(infeasible, feasible) capacities as near as ``known`` lets them come."""

    def search(bound: int, lo: int, hi: int) -> int:
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _greedy(known, mid, n, bound)[-1] >= total else (mid, hi)
        return hi

    feasible = search(0, low, high)
    return search(1, low, feasible) - 1, feasible


def minimax_cuts(groups: DataFrame, total: int, n_shards: int, largest: int, blocks: int = BLOCKS) -> list[int]:
    """Ends of the shards as prefix sums. ``groups`` has ``start`` (sum over the groups before) and ``bytes``."""
    ends = groups.select((F.col("start") + F.col("bytes")).alias("e"))
    low, high = max(largest, -(-total // n_shards)) - 1, total
    windows = [(0, total)]
    known = _Known([total], [False])
    while True:
        width = max(1, sum(b - a for a, b in windows) // blocks)
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("e").between(a, b)
        rows = ends.filter(inside).groupBy(F.floor(F.col("e") / width).alias("k")).agg(F.min("e").alias("a"), F.max("e").alias("b"), F.count("*").alias("n")).orderBy("k").collect()
        fine, unknown = [], []
        for r in rows:
            fine += [(r["a"], False)] + ([(r["b"], True)] if r["b"] > r["a"] else [])
            unknown += [(r["a"], r["b"])] if r["n"] > 2 else []
        marks = sorted({*known.ends, *[e for e, _ in fine]})
        whole, spans = [], iter([*unknown, (None, None)])
        span, last = next(spans), 0
        outer = lambda a, b: any(x <= a and b <= y for x, y in windows)
        was = {e: w for e, w in zip(known.ends, known.whole, strict=True)}
        for e in marks:
            while span[0] is not None and span[1] < e:
                span = next(spans)
            hidden = span[0] is not None and span[0] <= last and e <= span[1]
            whole.append(not hidden if outer(last, e) else was.get(e, False))
            last = e
        known = _Known(marks, whole)
        low, high = minimax_capacity(known, total, n_shards, low, high)
        if high - low <= 1:
            return _greedy(known, high, n_shards, 0)
        near, far = _greedy(known, low, n_shards, 0), _greedy(known, high, n_shards, 1)
        windows = []
        for a, b in zip(near, far, strict=True):
            k = bisect.bisect_left(marks, a)
            a = marks[k - 1] if k else 0
            k = bisect.bisect_right(marks, b)
            b = marks[k] if k < len(marks) else total
            if windows and a <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes and 1), text_crc32, shard and slot (place in its shard, gapless from 0)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("digest"))
    narrow = materialize(narrow, "shard-rows")
    # a null id sorts before any other
    first = F.min(F.struct(F.col("id").isNotNull().alias("has"), "id"))
    groups = narrow.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), first.alias("first"))
    kept, before = running(groups, ["first", "digest"], {"bytes": "start", "n": "rows_before"}, "shard-groups")
    total = before[-1][1]
    placed = with_offsets(kept, before, ["start", "rows_before"])
    if total:
        largest = placed.agg(F.max("bytes")).first()[0]
        cuts = minimax_cuts(placed, total, n_shards, largest)
    else:
        cuts = [0] * n_shards
    # the rows before each shard: those before the first group that starts at or beyond its cut
    starts = [0, *cuts[:-1]]
    counts = placed.select(_shard_of("start", starts).alias("shard"), "n").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    by = {r["shard"]: r["n"] for r in counts}
    rows_before = [sum(by.get(j, 0) for j in range(k)) for k in range(n_shards)]
    rows = narrow.join(placed.select("digest", "first", "start"), "digest")
    rows = rows.select("id", "size", "crc", "digest", "first", _shard_of("start", starts).alias("shard"), F.lit(1).cast("long").alias("one"))
    dealt, offsets = running(rows, ["first", "digest", "id", "size"], {"one": "place"}, "shard-places")
    base = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in rows_before]), F.col("shard") + 1)
    return with_offsets(dealt, offsets, ["place"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - base).alias("slot"))


def _shard_of(start: str, starts: list[int]):
    """The last shard that starts at or before ``start``; of shards that start together the last holds the groups, the others are empty."""
    out = F.lit(0)
    for k, s in enumerate(starts):
        out = F.when(F.col(start) >= F.lit(int(s)), F.lit(k)).otherwise(out)
    return out.cast("int")


# the query ------------------------------------------------------------------------------------------------------------


def op10_minimax_sharding(spark, sf_dir):
    from lectern.llm.staging import table

    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_minimax_sharding": op10_minimax_sharding}
SQL: dict[str, str] = {}
