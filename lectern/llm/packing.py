"""Best-fit packing by the linear grouping scheme.

Texts become token pieces of at most ``capacity`` ids, and pieces are laid into as few sequences as the scheme finds:

1. the large lengths, in descending order, are parted into ``groups`` groups of equal cardinality, and each length is
   rounded up to the largest of its group, so that few sizes are left;
2. configurations of these sizes (multisets that fit into a sequence) are optimised by column generation: a linear
   programme whose columns are priced by a knapsack, its solution rounded down;
3. actual pieces take the places of the rounded ones;
4. pieces left over by the rounding, and then the small ones, go best-fit, longest first, into the space that is left.

All of this works on the histogram of lengths, which has at most ``capacity`` entries however many pieces there are:
pieces of one length are interchangeable, so a plan says "pieces number a to b of length l lie at this offset in sequences
c to d". The driver holds the histogram and the plan; a task finds a piece's place by looking up (length, number among
its equals). These numbers come from counts of each length in each task, so a length that a third of all pieces share
costs nothing more, and no piece is shuffled but for the join with those counts.

A text longer than the capacity, however long, is cut into pieces of the full capacity, the first piece being the shorter one. A null or
empty text is its end id alone. Null ids and repeated rows are packed like any other row. Columns other than id and text
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.staging import materialize, small_arrow, table
from lectern.llm.tokens import default_path, encoder, small_batches, with_end

CAPACITY, GROUPS = 1024, 128
#: Lengths up to capacity // SMALL are small.
SMALL = 3
#: Bytes of texts that are encoded at once.
TEXT_BYTES = 1 << 20


# the plan: from a histogram of lengths to runs of places --------------------------------------------------------------


class _Stock:
    """Pieces of one group, longest first, as (length, first number, count)."""

    def __init__(self, parts: list[tuple[int, int, int]]):
        self.parts = parts[::-1]

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n and self.parts:
            length, first, count = self.parts.pop()
            m = min(n, count)
            out.append((length, first, m))
            if m < count:
                self.parts.append((length, first + m, count - m))
            n -= m
        return out


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int, int]]]:
    """Lengths in descending order, parted into groups of equal cardinality; a length may lie in several groups."""
    total = sum(counts.values())
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(groups)]
    done = 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            g = min(groups - 1, done * groups // total)
            m = min(left, -(-(g + 1) * total // groups) - done) if g < groups - 1 else left
            m = max(1, m)
            out[g].append((length, first, m))
            first, left, done = first + m, left - m, done + m
    return [x for x in out if x]


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``capacity``."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], fits = best[c - 1], np.flatnonzero(sizes <= c)
        if len(fits):
            v = best[c - sizes[fits]] + worth[fits]
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], last[c] = v[k], fits[k]
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """(multiset of sizes, how many sequences): the linear programme's basic solution, rounded down. It is optimal, or the caller is
    warned: any basis is a valid plan, so what is left after ``rounds`` steps is used."""
    s, d = np.array(sizes), np.array(demand, float)
    m = len(s)
    basis = np.diag([float(capacity // x) for x in sizes])
    x = d / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        worth, column = _knapsack(s, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        t = ratio[out]
        x = x - t * step
        x[out] = t
        basis[:, out] = column
    else:
        warnings.warn(f"configurations are not optimal after {rounds} steps", stacklevel=2)
    return [(basis[:, k].round().astype(np.int64), int(np.floor(x[k] + 1e-9))) for k in range(m)]


class Plan:
    """Places as rows (length, first number, count, first sequence, offset): piece ``first + i`` lies at ``offset`` in sequence ``first sequence + i``."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, count)
        self.spaces: list[int] = []

    def put(self, length: int, first: int, count: int, sequence: int, offset: int) -> None:
        if count:
            self.rows.append((length, first, count, sequence, offset))

    def leave(self, space: int, sequence: int, count: int) -> None:
        if count and space:
            if space not in self.open:
                self.open[space] = []
                bisect.insort(self.spaces, space)
            self.open[space].append((sequence, count))

    def fill(self, slots: list[list[tuple[int, int, int]]], copies: int) -> None:
        """New sequences; slot k of copy i holds the i-th piece of ``slots[k]``, which may run out."""
        ends = sorted({copies, *[e for parts in slots for e in np.cumsum([c for _, _, c in parts]).tolist() if e < copies]})
        at = [[0, 0] for _ in slots]
        begin = 0
        for end in ends:
            n, offset = end - begin, 0
            for k, parts in enumerate(slots):
                i, used = at[k]
                if i < len(parts):
                    length, first, count = parts[i]
                    self.put(length, first + used, n, self.sequences, offset)
                    offset += length
                    at[k] = [i, used + n] if used + n < count else [i + 1, 0]
            if offset:
                self.leave(self.capacity - offset, self.sequences, n)
                self.sequences += n
            begin = end

    def best_fit(self, length: int, first: int, count: int) -> None:
        """Each piece into the tightest space; one space takes as many as it holds before the next does."""
        while count:
            k = bisect.bisect_left(self.spaces, length)
            if k == len(self.spaces):
                each = self.capacity // length
                n = max(1, count // each)
                self.leave(self.capacity, self.sequences, n)
                self.sequences += n
                continue
            space = self.spaces[k]
            sequence, there = self.open[space].pop()
            if not self.open[space]:
                del self.open[space]
                self.spaces.pop(k)
            each = min(space // length, count)
            n = min(there, count // each)
            for i in range(each):
                self.put(length, first + i * n, n, sequence, self.capacity - space + i * length)
            first, count = first + each * n, count - each * n
            self.leave(space - each * length, sequence, n)
            self.leave(space, sequence + n, there - n)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """A place for every piece of a histogram of lengths."""
    out = Plan(capacity)
    out.fill([[(capacity, 0, histogram.get(capacity, 0))]], histogram.get(capacity, 0))
    small = int(capacity / SMALL)
    large = {n: c for n, c in histogram.items() if small < n < capacity}
    left = [(n, 0, c) for n, c in histogram.items() if n <= small]
    if large:
        grouped = group_lengths(large, min(groups, len(large)))
        sizes, stocks = [g[0][0] for g in grouped], [_Stock(g) for g in grouped]
        merged = _merged(sizes, [sum(c for _, _, c in g) for g in grouped])
        members = {s: [k for k, x in enumerate(sizes) if x == s] for s in merged}
        for column, copies in configurations(list(merged), list(merged.values()), capacity):
            slots = []
            for s, a in zip(merged, column, strict=True):
                slots += [_take(stocks, members[s], copies) for _ in range(int(a))]
            if copies:
                out.fill(slots, copies)
        for s in stocks:
            left += s.parts
    for length, first, count in sorted(left, key=lambda x: -x[0]):
        out.best_fit(length, first, count)
    return out


def _merged(sizes: list[int], demand: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s, d in zip(sizes, demand, strict=True):
        out[s] = out.get(s, 0) + d
    return out


def _take(stocks: list[_Stock], which: list[int], n: int) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for k in which:
        got = stocks[k].take(n)
        out += got
        n -= sum(c for _, _, c in got)
    return out


# pieces ---------------------------------------------------------------------------------------------------------------


def _cutter(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches):
        enc, seen, pid = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in small_batches(batches, TEXT_BYTES):
            ids, counts = enc.encode(b.column(1))
            ids, counts, offs = with_end(ids, counts, end_id)
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lead = counts - (n - 1) * capacity
            length = np.where(piece == 0, lead[doc], capacity)
            start = np.where(piece == 0, 0, lead[doc] + (piece - 1) * capacity)
            begin = offs[doc] + start
            crc = [zlib.crc32(ids[x : x + y]) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
            # the number of a piece among its equals in this task
            order = np.argsort(length, kind="stable")
            at = np.zeros(capacity + 2, np.int64)
            np.add.at(at, length + 1, 1)
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - np.cumsum(at)[length[order]] + seen[length[order]]
            seen += at[1:]
            cols = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), pid), pa.int32()), pa.array(number, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "number"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids, pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _finder(rows: np.ndarray):
    key, count, sequence, offset = rows[:, 0] * (1 << 44) + rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4]

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            number = b.column("number").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, length * (1 << 44) + number, side="right") - 1
            i = number - (key[k] & ((1 << 44) - 1))
            if (i >= count[k]).any():
                raise ValueError("a piece has no place in the plan")
            drop = [x for x in b.schema.names if x not in ("number", "pid")]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in drop], pa.array(sequence[k] + i), pa.array(offset[k])], names=[*drop, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if ``keep_ids``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`"))
    ids = ", ids array<long>" if keep_ids else ""
    pieces = rows.mapInArrow(_cutter(tokenizer or default_path(), end_id, capacity, keep_ids), f"doc_id long, piece int, start long, length long, ids_crc32 long, pid int, number long{ids}")
    with small_arrow(spark):
        cut = materialize(pieces, "pieces")
    per_task = cut.groupBy("length", "pid").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return spark.createDataFrame([], f"{id_col} long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")
    found = plan(histogram, capacity, groups)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "pid"]).withColumn("number", F.col("number") + F.col("base")).drop("base")
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "pid", "number", *(["ids"] if keep_ids else []))
    places = np.array(sorted(found.rows), np.int64)
    return numbered.mapInArrow(_finder(places), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)


# the query ------------------------------------------------------------------------------------------------------------


def op5_linear_grouping_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_linear_grouping_packing": op5_linear_grouping_packing}
SQL: dict[str, str] = {}
