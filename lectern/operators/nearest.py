"""Approximate nearest neighbours by cosine: inverted lists over k-means cells, product-quantised residuals, exact rescoring.

Below ``path`` lie the model and ``lists``, in folders by cell: up to ``LIST`` vectors of a cell to a row, their ids, codes, errors and
unit vectors; a cell of any size is many rows and files. The model is fitted on at most ``SAMPLE`` numbers' worth of rows, the ones
with the smallest hashes of their ids, in one task; every row is indexed.

Queries are the bounded side, as in ``retrieval.dense``: they go to every task in blocks, lists stay where they are, and a task
hands on its best of each query, so nothing grows with queries times cells. A list meets the queries whose nearest cells its cell is
one of, and gets distances from tables of codewords. The ``depth`` nearest by code of each query are rescored by their vectors;
until then only codes are read. With ``depth`` None nothing is lost within the probed cells: a code's error is known, so by the
triangle inequality only what could not be among the best k of its task is left out, the rest is scored beside its code, and with
all cells probed the result is that of ``retrieval.dense``.

Null ids and null, empty or zero vectors are not indexed and ask for nothing; any other length than the model's fails. Rows of one
id are all kept.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.retrieval import Best, query_blocks, top_k
from lectern.sources.shared import staged

#: Numbers in the sample that a model is fitted on; vectors, and numbers of theirs, to a row of a list; queries that meet a list at once.
SAMPLE, LIST, NUMBERS, QUERIES = 8_000_000, 4096, 1 << 18, 256
#: Room for rounding where bounds are compared.
ROUNDING = 1e-5


def _units(v: pa.Array, dim: int | None) -> np.ndarray:
    if dim is None:
        dim = len(v[0]) if len(v) else 1
    if (pc.list_value_length(v).to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"a vector does not have {dim} numbers")
    x = pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of each row, the nearest first."""
    d = (centres**2).sum(1)[None] - 2 * x @ centres.T
    return d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """At most ``k`` centres. A centre that has lost its rows moves to the row that is worst served."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            worst = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty] = x[worst]
    return centres


class Model:
    """Cells' centres, and codewords (parts x words x numbers) of what is left of a vector."""

    def __init__(self, centres: np.ndarray, words: np.ndarray):
        self.centres, self.words = centres, words

    @staticmethod
    def fit(x: np.ndarray, cells: int, parts: int, words: int = 256) -> Model:
        centres = k_means(x, cells)
        rest = x - centres[_nearest(x, centres)[:, 0]]
        width = -(-x.shape[1] // parts)
        rest = np.pad(rest, ((0, 0), (0, width * parts - x.shape[1])))
        books = [k_means(rest[:, m * width : (m + 1) * width], words, seed=m + 1) for m in range(parts)]
        return Model(centres, np.stack(books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, distance of the vector from what its code says)."""
        cell = _nearest(x, self.centres)[:, 0]
        rest = self._rest(x, cell)
        code = np.stack([_nearest(rest[:, m], self.words[m])[:, 0] for m in range(len(self.words))], 1).astype(np.uint8)
        said = self.words[np.arange(len(self.words))[None], code]
        return cell, code, np.sqrt(((rest - said) ** 2).sum((1, 2)))

    def _rest(self, x: np.ndarray, cell) -> np.ndarray:
        rest = x - self.centres[cell]
        parts, _, width = self.words.shape
        return np.pad(rest, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Queries x codes: from each query to what each code of the cell says."""
        rest = self._rest(q, cell)
        out = np.zeros((len(q), len(codes)))
        for m, words in enumerate(self.words):
            table = ((rest[:, m, None] - words[None]) ** 2).sum(2)
            out += table[:, codes[:, m]]
        return np.sqrt(out)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, words=self.words)
        return out.getvalue()

    @staticmethod
    def from_bytes(b: bytes) -> Model:
        got = np.load(io.BytesIO(b))
        return Model(got["centres"], got["words"])


def _usable(df: DataFrame, id_col: str) -> DataFrame:
    some = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & some).select(F.col(id_col).cast("long").alias(id_col), "vector")


class VectorIndex:
    """``build`` writes an index of (doc_id, vector), ``add`` adds to it, ``search`` asks it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._model: Model | None = None

    def build(self, docs: DataFrame, cells: int | None = None, parts: int = 16) -> VectorIndex:
        """``cells``: about the root of the number of rows, if not given; ``parts``: bytes of a code."""
        rows = _usable(docs, "doc_id")
        first = rows.select(F.size("vector").alias("n")).first()
        if first is None:
            raise ValueError("no vector to build an index of")
        dim, cells = first["n"], cells or max(1, round(rows.count() ** 0.5))
        sample = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max(1, SAMPLE // dim)).select("vector")

        def fit(batches):
            x = np.concatenate([_units(b.column(0), dim) for b in batches if b.num_rows])
            yield pa.RecordBatch.from_arrays([pa.array([Model.fit(x, min(cells, len(x)), parts).to_bytes()], pa.binary())], names=["model"])

        sample.coalesce(1).mapInArrow(fit, "model binary").write.mode("overwrite").parquet(f"{self.path}/model")
        return self.add(docs)

    @property
    def model(self) -> Model:
        if self._model is None:
            self._model = Model.from_bytes(bytes(self.spark.read.parquet(f"{self.path}/model").first()[0]))
        return self._model

    def add(self, docs: DataFrame) -> VectorIndex:
        """Every row goes to its cell."""
        sent = self.spark.sparkContext.broadcast(self.model.to_bytes())

        def encode(batches):
            model = Model.from_bytes(sent.value)
            for b in batches:
                if b.num_rows:
                    x = _units(b.column(1), model.centres.shape[1])
                    cell, code, error = model.encode(x)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(list(x), pa.list_(pa.float64()))], names=["cell", "doc_id", "code", "error", "vector"])

        rows = staged(_usable(docs, "doc_id").mapInArrow(encode, "cell int, doc_id long, code binary, error double, vector array<double>"), "encoded")
        shards = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(shards, "cell", "doc_id").sortWithinPartitions("cell", "doc_id")
        width = max(1, min(LIST, NUMBERS // self.model.centres.shape[1]))

        def lists(batches):
            """Rows come sorted by cell; a row of lists ends with its cell, its batch or ``width`` vectors."""
            for b in batches:
                cell = b.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                starts = [s for a, e in zip([0, *cuts], [*cuts, len(cell)], strict=True) for s in range(a, e, width)]
                for a, e in zip(starts, [*starts[1:], len(cell)], strict=True):
                    part = b.slice(a, e - a)
                    one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                    vectors = np.ascontiguousarray(part.column(4).flatten().to_numpy(zero_copy_only=False), "<f8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])], pa.int32()), one(part.column(1)), pa.array([b"".join(part.column(2).to_pylist())], pa.binary()), one(part.column(3)), pa.array([vectors], pa.binary())], names=["cell", "ids", "codes", "errors", "vectors"])

        packed = dealt.select("cell", "doc_id", "code", "error", "vector").mapInArrow(lists, "cell int, ids array<long>, codes binary, errors array<double>, vectors binary")
        packed.write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")
        return self

    def search(self, queries: DataFrame, k: int, probes: int, depth: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the k documents of the largest cosine within the ``probes`` nearest cells of each query
        (query_id, vector); ``depth``: how many of them by their codes are rescored, None for all that could matter."""
        out = None
        for block in query_blocks(_usable(queries, "query_id")):
            ids, q = np.array([r[0] for r in block], np.int64), _units(pa.array([r[1] for r in block], pa.list_(pa.float64())), self.model.centres.shape[1])
            part = self._scored(ids, q, k, probes) if depth is None else self._rescored(ids, q, k, probes, depth)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        return top_k(out, k)

    def _scan(self, q: np.ndarray, probes: int, *columns: str):
        """Lists, and what reads them: (block of queries, its rows that ask the list's cell, distances by code, the list)."""
        sent = self.spark.sparkContext.broadcast((self.model.to_bytes(), q))
        kinds = {"ids": "array<long>", "codes": "binary", "errors": "array<double>", "vectors": "binary"}
        lists = self.spark.read.schema(", ".join(f"{c} {t}" for c, t in kinds.items()) + ", cell int").parquet(f"{self.path}/lists").select("cell", "ids", "codes", *columns)

        def met(batches):
            raw, q = sent.value
            model = Model.from_bytes(raw)
            asks = None
            if probes < len(model.centres):
                asks = np.zeros((len(q), len(model.centres)), bool)
                for at in range(0, len(q), QUERIES):
                    cells = _nearest(q[at : at + QUERIES], model.centres, max(2, probes))[:, :probes]
                    np.put_along_axis(asks[at : at + QUERIES], cells, True, 1)
            for b in batches:
                for i in range(b.num_rows):
                    cell = b.column(0)[i].as_py()
                    r = {c: b.column(c)[i] for c in ("ids", "codes", *columns)}
                    listed = {"ids": r["ids"].values.to_numpy(), "codes": np.frombuffer(r["codes"].as_py(), np.uint8).reshape(-1, len(model.words))}
                    if "errors" in r:
                        listed |= {"errors": r["errors"].values.to_numpy(), "vectors": np.frombuffer(r["vectors"].as_py(), "<f8").reshape(-1, q.shape[1])}
                    for at in range(0, len(q), QUERIES):
                        rows = at + (np.arange(len(q[at : at + QUERIES])) if asks is None else np.flatnonzero(asks[at : at + QUERIES, cell]))
                        if len(rows):
                            yield at // QUERIES, rows, model.distances(q[rows], cell, listed["codes"]), listed

        return lists, met

    def _scored(self, ids: np.ndarray, q: np.ndarray, k: int, probes: int) -> DataFrame:
        """(query_id, doc_id, score): a task's best k, of all that codes and their errors leave."""
        lists, met = self._scan(q, probes, "errors", "vectors")

        def run(batches):
            starts = range(0, len(ids), QUERIES)
            best = [Best(len(ids[s : s + QUERIES]), k) for s in starts]
            for block, rows, d, listed in met(batches):
                held, own = best[block], rows - block * QUERIES
                reach, n = d + listed["errors"], min(k, len(listed["ids"]))
                limit = np.partition(reach, n - 1, axis=1)[:, n - 1 : n] if n == k else np.full((len(d), 1), np.inf)
                kth = held.scores[own, k - 1] if held.scores.shape[1] >= k else np.full(len(own), -np.inf)
                # a cosine and a distance of unit vectors say the same
                limit = np.minimum(limit, np.sqrt(np.maximum(0.0, 2 - 2 * kth))[:, None])
                left = d - listed["errors"] <= limit + ROUNDING
                about = np.where(left, q[rows] @ listed["vectors"].T, -np.inf)
                least = np.partition(about, len(listed["ids"]) - n, axis=1)[:, len(listed["ids"]) - n] if n == k else np.full(len(own), -np.inf)
                # products of equal vectors differ in their last digits by where they stand, sums of a pair do not
                at, which = np.nonzero(left & (about >= np.maximum(least, kth)[:, None] - ROUNDING))
                score = np.full((len(held.scores), len(listed["ids"])), -np.inf)
                score[own[at], which] = (q[rows[at]] * listed["vectors"][which]).sum(1)
                some = np.isfinite(score).any(0)
                if some.any():
                    held.add(listed["ids"][some], score[:, some])
            for s, held in zip(starts, best, strict=True):
                yield held.rows(ids[s : s + QUERIES])

        return lists.mapInArrow(run, "query_id long, doc_id long, score double")

    def _rescored(self, ids: np.ndarray, q: np.ndarray, k: int, probes: int, depth: int) -> DataFrame:
        """(query_id, doc_id, score) of the ``depth`` nearest by code."""
        lists, met = self._scan(q, probes)

        def run(batches):
            starts = range(0, len(ids), QUERIES)
            best = [Best(len(ids[s : s + QUERIES]), depth) for s in starts]
            for block, rows, d, listed in met(batches):
                near = np.full((len(best[block].scores), d.shape[1]), -np.inf)
                near[rows - block * QUERIES] = -d
                best[block].add(listed["ids"], near)
            for s, held in zip(starts, best, strict=True):
                yield held.rows(ids[s : s + QUERIES])

        found = top_k(lists.mapInArrow(run, "query_id long, doc_id long, score double"), depth).select("query_id", "doc_id").distinct()
        sent = self.spark.sparkContext.broadcast((ids, q))
        # each vector of the lists by its id
        rows = self.spark.read.schema("ids array<long>, vectors binary").parquet(f"{self.path}/lists")

        def vectors(batches):
            dim = sent.value[1].shape[1]
            for b in batches:
                for i in range(b.num_rows):
                    x = np.frombuffer(b.column(1)[i].as_py(), "<f8")
                    yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.FixedSizeListArray.from_arrays(pa.array(x), dim).cast(pa.list_(pa.float64()))], names=["doc_id", "vector"])

        met = rows.mapInArrow(vectors, "doc_id long, vector array<double>").join(found, "doc_id")

        def rescore(batches):
            ids, q = sent.value
            order = np.argsort(ids, kind="stable")
            for b in batches:
                if b.num_rows:
                    asked = order[np.searchsorted(ids[order], b.column(0).to_numpy())]
                    score = (q[asked] * _units(b.column(2), q.shape[1])).sum(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["query_id", "doc_id", "score"])

        return met.select("query_id", "doc_id", "vector").mapInArrow(rescore, "query_id long, doc_id long, score double")
