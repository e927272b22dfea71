"""Which documents hold which names, and which names hold which texts, without comparing all with all.

Names are the bounded side. For documents that hold names, an Aho-Corasick automaton of the distinct names goes to every task and
reads each document once, whatever the number of names; names of more than ``BLOCK_CHARS`` characters together make several
automata, and a pass over the documents each. For names that hold texts, all names stand in one suffix array: a text is found in
it by halving, in time that grows with the text and the logarithm of the names.

A null name or text holds nothing and is held by nothing; the empty one is held by every other that is not null. Equal names each
have their pairs; a pair comes once however often a name occurs in a document, and once for each of its rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # pragma: no cover  the join that this module is there to spare is left
    ahocorasick = None

#: Characters of names in one automaton, which takes some tens of bytes for each.
BLOCK_CHARS = 4 << 20


def _blocks(names: DataFrame, name_col: str):
    """Distinct names in blocks of bounded size."""
    block, chars = [], 0
    for (name,) in names.filter(F.col(name_col).isNotNull()).select(name_col).distinct().toLocalIterator():
        if block and chars + len(name) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(name)
        chars += len(name)
    if block:
        yield block


def _with_ids(pairs: DataFrame | None, docs: DataFrame, names: DataFrame, id_col: str, name_id: str, name_col: str) -> DataFrame:
    """(name_id, id) of (id, name)."""
    if pairs is None:
        return names.select(name_id).crossJoin(docs.select(id_col)).limit(0)  # no name, no pair: only the columns matter
    return pairs.join(names.select(name_id, F.col(name_col).alias("__name")), "__name").select(name_id, id_col)


def holding(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_id: str = "query_id", name_col: str = "name", at_start: bool = False) -> DataFrame:
    """(name_id, id): documents whose text holds a name, or, ``at_start``, begins with it."""
    rows, out = docs.select(id_col, text_col), None
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, __name string"
    for block in _blocks(names, name_col):
        if ahocorasick is None:
            small = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in block], "__name string"))
            part = rows.join(small, F.startswith(text_col, "__name") if at_start else F.contains(text_col, "__name")).select(id_col, "__name")
        else:
            machine = ahocorasick.Automaton()
            for name in block:
                if name:
                    machine.add_word(name, name)
            if len(machine):
                machine.make_automaton()
            sent = docs.sparkSession.sparkContext.broadcast((machine if len(machine) else None, "" in block))

            def run(batches, sent=sent):
                machine, empty = sent.value
                for b in batches:
                    at, found = [], []
                    for k, text in enumerate(b.column(1).to_pylist()):
                        if text is None:
                            continue
                        hits = {name for end, name in machine.iter(text) if not at_start or end + 1 == len(name)} if machine else set()
                        hits |= {""} if empty else set()
                        at += [k] * len(hits)
                        found += hits
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[id_col, "__name"])

            part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return _with_ids(out, docs, names, id_col, name_id, name_col)


class Suffixes:
    """A suffix array over texts."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        # a mark behind each text that is in none of them: code points are moved up by one
        self.chars = np.concatenate([*[np.append(np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64) + 1, 0) for t in texts], np.zeros(0, np.int64)])
        self.owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        rank, width = self.chars, 1
        n = len(rank)
        self.order = np.argsort(rank, kind="stable")
        while n:
            later = np.concatenate([rank[width:], np.full(min(width, n), -1)])
            self.order = np.lexsort((later, rank))
            new = (np.diff(rank[self.order], prepend=-2) != 0) | (np.diff(later[self.order], prepend=-2) != 0)
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(new) - 1
            if rank.max() == n - 1 or width > n:
                break
            width *= 2
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)

    def _at(self, place: int, length: int) -> str:
        own = self.owner[place]
        begin = place - self.starts[own]
        return self.texts[own][begin : begin + length]

    def holding(self, text: str) -> list[int]:
        """Numbers of the texts that hold ``text``."""
        if not text:
            return list(range(len(self.texts)))
        begins = lambda p: self._at(p, len(text))
        low = bisect.bisect_left(self.order, text, key=begins)
        high = bisect.bisect_right(self.order, text, lo=low, key=begins)
        return np.unique(self.owner[self.order[low:high]]).tolist()


def held(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_id: str = "query_id", name_col: str = "name") -> DataFrame:
    """(name_id, id): documents whose text is held by a name, the other way round than ``holding``."""
    rows, out = docs.select(id_col, text_col), None
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, __name string"
    for block in _blocks(names, name_col):
        sent = docs.sparkSession.sparkContext.broadcast(Suffixes(block))

        def run(batches, sent=sent):
            suffixes = sent.value
            for b in batches:
                at, found = [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    hits = [] if text is None else suffixes.holding(text)
                    at += [k] * len(hits)
                    found += [suffixes.texts[h] for h in hits]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[id_col, "__name"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return _with_ids(out, docs, names, id_col, name_id, name_col)
