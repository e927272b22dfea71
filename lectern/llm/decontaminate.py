"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every three-word gram of a test item is a seed. So a copy is looked at wherever three words of it in a row are
   unchanged, whatever else was edited and however often the item or the gram occurs.
2. A document's seeds say which stretches of it to align with which item. Seeds around which too few of the item's words
   stand to reach the threshold are passed over (a bound, so nothing is lost by it); all others are aligned (match 2,
   mismatch and gap -1). The score is that of the best local alignment over that of a full copy, so edited, shortened and
   paraphrased copies have scores below 1.
3. A part of an item is a copy too, however long the item is: a stretch below the threshold is a hit if it holds a passage
   worth ``PASSAGE`` words in a row, found by a second alignment in which an edit costs ``EDIT``, as much as two matches
   bring. An alignment of that worth has ``PASSAGE`` - 2 unchanged grams at least, so other stretches are not aligned.

Test items are the stated query set: they are read in blocks of ``BLOCK_CHARS`` characters, and each block is sent to
every task; documents are never shuffled, and a document's alignments are made where it was read.

A text of any length is scanned whole, and aligned only around its seeds; an item of any length is a block of its own at most.
Words are runs of letters, digits and underscores in lower case. Items of fewer than three words have no gram and match
nothing; a null or empty text holds nothing. Repeated rows are scored one by one, ties between stretches go to the first,
and columns other than ids and texts are ignored by ``scan`` and kept by ``clean``. Empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import table
from lectern.llm.tokens import give_back, small_batches

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
PASSAGE, EDIT = 13, 4
BLOCK_CHARS = 4 << 20
#: Documents that are judged and handed on at a time.
ROWS = 256

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """A block of test items: words as numbers, and the codes of their grams."""

    def __init__(self, ids: list, texts: list[str]):
        self.vocab: dict[str, int] = {}
        self.ids, self.items = [], []
        for i, t in zip(ids, texts, strict=True):
            w = words(t)
            if len(w) >= GRAM:
                self.ids.append(i)
                self.items.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64))
        self.size = len(self.vocab) + 1
        self.distinct, self.counts = zip(*[np.unique(x, return_counts=True) for x in self.items], strict=True) if self.items else ((), ())
        rows = np.array(sorted((int(c), k, i) for k, x in enumerate(self.items) for i, c in enumerate(self.codes(x))), np.int64).reshape(-1, 3)
        self.seeds, self.first = np.unique(rows[:, 0], return_index=True)
        self.first = np.append(self.first, len(rows))
        self.postings = rows[:, 1:]

    def number(self, ws: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A code for each gram, -1 where it has a word that no item has."""
        if len(x) < GRAM:
            return np.zeros(0, np.int64)
        a, b, c = x[:-2], x[1:-1], x[2:]
        # beyond two million words codes wrap round; two grams with one code only make more to align
        code = ((a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64)) * np.uint64(self.size) + c.astype(np.uint64)) & np.uint64((1 << 63) - 1)
        return np.where((a < 0) | (b < 0) | (c < 0), -1, code.astype(np.int64))


def align(item: np.ndarray, part: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int]:
    """(score, end in item, end in part) of the best local alignment; ends are one behind."""
    h, ramp = np.zeros(len(part) + 1, np.int64), np.arange(len(part) + 1) * gap
    best = (0, 0, 0)
    for i, w in enumerate(item.tolist()):
        t = np.zeros(len(part) + 1, np.int64)
        np.maximum(h[:-1] + np.where(part == w, MATCH, mismatch), h[1:] - gap, out=t[1:])
        t[t < 0] = 0
        h = np.maximum.accumulate(t + ramp) - ramp
        j = int(np.argmax(h))
        if h[j] > best[0]:
            best = (int(h[j]), i + 1, j)
    return best


def common(items: Items, item: int, part: np.ndarray) -> int:
    """How many words the item and ``part`` can have in common at most, each as often as both have it."""
    known = items.distinct[item]
    k = np.minimum(np.searchsorted(known, part), len(known) - 1)
    return int(np.minimum(np.bincount(k[known[k] == part], minlength=len(known)), items.counts[item]).sum())


def hits(items: Items, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item's number, score, first word, word behind the last) of each item that ``text`` copies, its best stretch."""
    x = items.number(words(text))
    codes = items.codes(x)
    at = np.flatnonzero(codes >= 0)
    if not len(at) or not len(items.seeds):
        return []
    k = np.minimum(np.searchsorted(items.seeds, codes[at]), len(items.seeds) - 1)
    real = items.seeds[k] == codes[at]
    at, k = at[real], k[real]
    if not len(at):
        return []
    n = items.first[k + 1] - items.first[k]
    rows = items.postings[np.repeat(items.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    at = np.repeat(at, n)
    order = np.lexsort((at - rows[:, 1], rows[:, 0]))
    owner, at, starts_at = rows[order, 0], at[order], (at - rows[:, 1])[order]  # item, where the gram stands and where the item's first word would
    out: dict[int, tuple[int, float, int, int]] = {}
    groups = np.flatnonzero(np.diff(owner, prepend=-1))
    for b, e in zip(groups, [*groups[1:], len(owner)], strict=True):
        item = int(owner[b])
        words_of = items.items[item]
        size = len(words_of)
        held = np.append(0, np.cumsum(np.isin(x, items.distinct[item])))
        need = threshold * size
        least = min(need, PASSAGE) if e - b > PASSAGE - GRAM else need
        if held[-1] < least:
            continue
        reach = 3 * size + GRAM  # a local alignment has at most a match for each word and two gaps for each match
        near = held[np.minimum(at[b:e] + reach, len(x))] - held[np.maximum(at[b:e] - reach, 0)]
        starts = starts_at[b:e][near >= least]
        if not len(starts):
            continue
        cuts = np.flatnonzero(np.diff(starts) > size) + 1
        for s in np.split(starts, cuts):
            low, high = max(0, int(s[0]) - size), min(len(x), int(s[-1]) + 2 * size)
            part = x[low:high]
            if common(items, item, part) < (least if len(s) > PASSAGE - GRAM else need):
                continue
            score, i, j = align(words_of, part)
            share = score / (MATCH * size)
            if share < threshold and (score < MATCH * PASSAGE or align(words_of, part, -EDIT, EDIT)[0] < MATCH * PASSAGE):
                continue
            if item not in out or share > out[item][1]:
                back = align(words_of[:i][::-1], part[:j][::-1])
                out[item] = (item, share, low + j - back[2], low + j)
    return [out[k] for k in sorted(out)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS):
    """The test items in blocks of bounded size."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1] or "")
        held += len(texts[-1])
        if held >= chars:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item that it copies: ids, score, first_word and end_word of the copy in the document."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"{id_col} long, {item_col} long, score double, first_word long, end_word long")
    for items in blocks(benchmark, item_col, item_text_col):

        def run(batches, items=items):
            for b in small_batches(batches):
                rows = [(d, items.ids[h[0]], round(h[1], 4), h[2], h[3]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in hits(items, t, threshold)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, item_col, "score", "first_word", "end_word"])

        out = out.union(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, out.schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that copy no item, with the input's columns. Each is judged where it was read."""
    out = docs
    for items in blocks(benchmark, item_col, item_text_col):

        # the text once, within the row; some rows at a time
        def run(batches, items=items, k=out.columns.index(text_col)):
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    yield b.filter(pa.array([not hits(items, t, threshold) for t in b.column(0).field(k).to_pylist()], pa.bool_()))
            give_back()

        rows = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row"))
        out = rows.mapInArrow(run, rows.schema).select("row.*")
    return out


# the query ------------------------------------------------------------------------------------------------------------


def op3_seed_and_align(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_seed_and_align": op3_seed_and_align}
SQL: dict[str, str] = {}
