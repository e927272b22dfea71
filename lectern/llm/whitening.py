"""Embedding whitening: two passes over the distinct vectors, one small eigenproblem, one projection of all rows.

Entries become integers, x = floor(scale * c). Each distinct vector of integers is fitted on once, so copies have no weight.
The first pass sums integers exactly, which gives the mean; the second sums the outer products of what is left after the mean
by one matrix product for each record batch. Tasks hand on one matrix each, which ``treeAggregate`` merges. LAPACK's symmetric
``eigh`` on the driver gives the components, whose size depends on the dimension alone; they are broadcast, and rows are
projected where they are read. A third pass over the distinct vectors measures how far the covariance of the whitened ones is
from the identity.

Rows go whose vector is null, holds null or non-finite entries, or entries that are no long after scaling, or has another
length than most vectors have (ties: the longer). An empty table, or one whose vectors are all equal, has no component and
gives an empty result. Components whose eigenvalue is not above the rounding of the largest are left out, as nothing can be
divided by them. Repeated rows each give their rows; null ids stay; no ties matter but those of equal eigenvalues, whose
components are any of the possible ones. ``deviation`` is exact: where it does not fit a long, the job fails and says so.
Columns other than id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import materialize, table

#: Vectors that are processed at a time.
ROWS = 2048


def _integers(vectors: pa.Array, dim: int | None, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be used, their integers). Without ``dim`` only the rows are told."""
    n = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    parent, flat = pc.list_parent_indices(vectors).to_numpy(), pc.list_flatten(vectors)
    with np.errstate(over="ignore"):
        x = np.floor(scale * pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    bad = ~(np.abs(x) < 2.0**63)
    ok = (n >= 0) & (np.bincount(parent[bad], minlength=len(n)) == 0)
    if dim is None:
        return np.flatnonzero(ok), n[ok]
    ok &= n == dim
    return np.flatnonzero(ok), x[ok[parent]].astype(np.int64).reshape(-1, dim)


def _slices(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            yield whole.slice(i, ROWS)


def dimension(vectors: DataFrame, scale: int) -> int:
    """The length that most usable vectors have; 0 if there is none."""

    def run(batches):
        for b in _slices(batches):
            size, n = np.unique(_integers(b.column(0), None, scale)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], names=["size", "n"])

    top = vectors.mapInArrow(run, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return top["size"] if top else 0


def fit_list(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(x): each distinct vector of integers once, as the bytes of longs, written down."""

    def run(batches):
        for b in _slices(batches):
            _, x = _integers(b.column(0), dim, scale)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["x"])

    return materialize(vectors.mapInArrow(run, "x binary").distinct(), "distinct-vectors")


def _longs(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _merged(rows: DataFrame, dim: int, part, zero, schema: str = "m binary"):
    """``part`` (batches of integers -> one array of a task) of every task, added up by ``treeAggregate``."""

    def run(batches):
        out = part(_longs(b.column(0), dim) for b in _slices(batches))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["m"])

    kind, shape = zero.dtype, zero.shape
    return rows.mapInArrow(run, schema).rdd.treeAggregate(zero, lambda a, r: a + np.frombuffer(r[0], kind).reshape(shape), lambda a, b: a + b)


def totals(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(number of vectors, their sums), exact: halves of longs are summed apart, and put together as whole numbers."""

    def part(batches):
        out = np.zeros((3, dim), np.int64)
        for x in batches:
            out += np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(dim, len(x))])
        return out

    high, low, n = _merged(rows, dim, part, np.zeros((3, dim), np.int64)).tolist()
    return n[0], [(h << 32) + s for h, s in zip(high, low, strict=True)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in longs where they are large enough, else in Python's whole numbers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _square_sums(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    most = int(np.abs(d).max(initial=0))
    if d.shape[1] * most * most < 1 << 63:
        return (d * d).sum(1).tolist() if d.dtype == np.int64 else [int(v) for v in (d * d).sum(1)]
    return [sum(int(v) ** 2 for v in r) for r in d]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def covariance(rows: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Divisor n, of vectors centred before they are multiplied."""

    def part(batches):
        out = np.zeros((dim, dim))
        for x in batches:
            c = _centred(x, n, sums)
            out += c.T @ c
        return out

    return _merged(rows, dim, part, np.zeros((dim, dim))) / n


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; components as columns) of a covariance, at most k that are above rounding."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    some = e > max(e[0], 0) * len(v) * np.finfo(float).eps if len(e) else np.zeros(0, bool)
    # either sign would do: the largest entry is positive
    u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(0)[None], 0)[0] < 0, -1.0, 1.0) if len(e) else u
    return e[some], u[:, some]


def identity_error(rows: DataFrame, dim: int, n: int, sums: list[int], w: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured over the distinct vectors."""
    k = w.shape[1]

    def part(batches):
        out = np.zeros((k + 1, k))
        for x in batches:
            y = _centred(x, n, sums) @ w
            out[:k] += y.T @ y
            out[k] += y.sum(0)
        return out

    got = _merged(rows, dim, part, np.zeros((k + 1, k))) / n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the first ``k``
    components. ``n``: distinct vectors; ``deviation``: the sum over dimensions of (n * x - S)^2, S their sums;
    ``explained``: the component's share of the whole variance."""
    spark = vectors.sparkSession
    flat = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    schema = f"id {flat.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], schema)
    dim = dimension(flat.select("v"), scale)
    if not dim:
        return empty.withColumnRenamed("id", id_col)
    rows = fit_list(flat.select("v"), dim, scale)
    n, sums = totals(rows, dim)
    v = covariance(rows, dim, n, sums)
    e, u = components(v, k)
    if not len(e):
        return empty.withColumnRenamed("id", id_col)
    w = u / np.sqrt(e)
    error, shares = identity_error(rows, dim, n, sums, w), e / np.trace(v)
    sent = spark.sparkContext.broadcast((n, sums, w, shares, error))

    def run(batches):
        n, sums, w, shares, error = sent.value
        k = w.shape[1]
        for b in _slices(batches):
            at, x = _integers(b.column(1), dim, scale)
            d = _deviations(x, n, sums)
            y = (d / n).astype(np.float64) @ w
            m = len(at)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(_square_sums(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(y.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return flat.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# the query ------------------------------------------------------------------------------------------------------------


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


#: Eigenvectors are beyond SQL; tests/llm has a version by NumPy alone.
QUERIES = {"op13_whitening": op13_whitening}
SQL: dict[str, str] = {}
