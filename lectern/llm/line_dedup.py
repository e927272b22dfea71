"""Line dedup: levelled sorted runs of line hashes, each new batch against the runs.

A line's key is the line without the blanks at its ends, A-Z in lower case; what is kept of it is a digest of 128 bits. Keys
found in at least ``least`` documents lose all their lines in every document, except keys of fewer than ``least_chars`` code
points.

``LineRuns`` holds for each key the number of documents it was found in, spread over sorted runs: Parquet tables in as many
buckets by key as Spark has shuffle partitions, each bucket sorted. A new batch is counted, merge-anti-joined with the keys
that a run has settled already (found often enough: counting on would change nothing), and what is left becomes a run of
level 0. Two runs of a level are merged into one of the next, so there are as many runs as the number of batches has digits of
two, and a key is rewritten once a level. Runs lie in the same buckets, so neither the anti-join nor a merge shuffles them; only a
batch's counts are shuffled, one row for each key and task.

The last pass drops lines where documents are read. Up to ``BROADCAST_KEYS`` frequent keys (they are counted first) go to
every task as 16 bytes each; beyond that each document's keys meet the frequent ones in a join, and a document gets the list
of its own, which holds no more than its lines.

A null or empty text is one empty line, whose key is empty. Texts of any length are processed whole, some megabytes at a time.
Each row is a document of its own, repeated rows and ids and null ids too; a key counts once for a row. No tie can arise.
Columns other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.staging import delete, materialize, new_path, table
from lectern.llm.tokens import small_batches

BLANKS = " \t\n\x0b\x0c\r"
#: Frequent keys that go to every task as they are; more are joined.
BROADCAST_KEYS = 200_000
#: Bytes of text that are processed at a time.
AT_ONCE = 16 << 20


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines of all texts, number of lines of each, the text that each belongs to)."""
    cut = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    return pc.list_flatten(cut), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(cut).to_numpy().astype(np.int64)


def _keys(lines: pa.Array, least_chars: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of its key for each line, digest of each key, whether a key is long enough)."""
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=BLANKS)).dictionary_encode()
    each = keys.dictionary
    digests = [xxhash.xxh3_128_digest(x) for x in each.cast(pa.large_binary()).to_pylist()]
    return keys.indices.to_numpy().astype(np.int64), digests, pc.greater_equal(pc.utf8_length(each), least_chars).to_numpy(zero_copy_only=False)


def _keys_by_text(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, key) for each key of each text, once, and the keys' digests."""
    lines, _, doc = _lines(texts)
    number, digests, ok = _keys(lines, least_chars)
    use = ok[number]
    pairs = np.unique(doc[use] * len(digests) + number[use])
    return pairs // len(digests), pairs % len(digests), digests


def _taken(digests: list[bytes], at: np.ndarray) -> pa.Array:
    return pa.array(digests, pa.binary()).take(pa.array(at))


def key_counts(docs: DataFrame, text_col: str = "text", least_chars: int = 1, batches: int = 1) -> DataFrame:
    """(h, docs, batch): the documents that each key was found in, summed over what a task reads at a time. The input's splits
    are dealt to ``batches`` batches, as files that arrive one after another would be."""

    def run(parts):
        for b in small_batches(parts, AT_ONCE):
            _, key, digests = _keys_by_text(b.column(0), least_chars)
            each, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([_taken(digests, each), pa.array(n)], names=["h", "docs"])

    counts = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "h binary, docs long")
    return counts.withColumn("batch", F.spark_partition_id() % batches)


class LineRuns:
    """Counts of documents by key in levelled sorted runs below a folder that all executors share."""

    def __init__(self, spark: SparkSession, least: int = 10):
        self.spark, self.least = spark, least
        self.path, self.buckets = new_path(spark, "line-runs"), int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (level, name of the table), the oldest first
        self.runs: list[tuple[int, str]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"lectern_run_{uuid.uuid4().hex}"
        counts.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.runs.append((level, name))

    def _merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one. They lie in the same buckets, so their join needs no shuffle."""
        a, b = self.spark.table(one), self.spark.table(other).withColumnRenamed("docs", "more")
        none = F.lit(0).cast("long")
        return a.join(b.hint("merge"), "h", "full_outer").select("h", (F.coalesce("docs", none) + F.coalesce("more", none)).alias("docs"))

    def _merge(self, one: str, other: str, level: int) -> None:
        self._write(self._merged(one, other), level)
        self._drop([one, other])

    def _drop(self, names: list[str]) -> None:
        self.runs = [r for r in self.runs if r[1] not in names]
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.path}/{name}")

    def add(self, counts: DataFrame) -> None:
        """A batch (h, docs) joins the runs, without the keys that they have settled."""
        new = counts.groupBy("h").agg(F.sum("docs").alias("docs"))
        for _, name in self.runs:
            settled = self.spark.table(name).filter(F.col("docs") >= self.least).select("h")
            new = new.join(settled.hint("merge"), "h", "left_anti")
        self._write(new, 0)
        # two runs of a level are merged into one of the next
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, one), (_, other) = self.runs[-2:]
            self._merge(one, other, level + 1)

    def compact(self) -> DataFrame:
        """(h, docs): all runs merged into one. A key that was settled early counts ``least`` or more, but not all its documents."""
        while len(self.runs) > 1:
            (level, one), (_, other) = self.runs[-2:]
            self._merge(one, other, level + 1)
        return self.spark.table(self.runs[0][1]) if self.runs else self.spark.createDataFrame([], "h binary, docs long")

    def frequent(self) -> DataFrame:
        """(h) of the keys found in ``least`` documents or more, written down."""
        return materialize(self.compact().filter(F.col("docs") >= self.least).select("h"), "frequent-lines")

    def close(self) -> None:
        self._drop([name for _, name in self.runs])


def _cutter(gone, least_chars: int):
    """Drop the lines whose key is in ``gone`` (a broadcast set of digests) or, where it is None, in the row's own list."""

    def run(parts):
        for b in small_batches(parts, AT_ONCE):
            lines, n_lines, doc = _lines(b.column(1))
            number, digests, ok = _keys(lines, least_chars)
            if gone is not None:
                drop = (ok & np.fromiter((d in gone.value for d in digests), bool, len(digests)))[number]
            else:
                place = {d: k for k, d in enumerate(digests)}
                own = b.column(2)
                listed = np.array([place[d] for d in pc.list_flatten(own).to_pylist()], np.int64)
                cells = pc.list_parent_indices(own).to_numpy().astype(np.int64) * len(digests) + listed
                drop = np.isin(doc * len(digests) + number, cells)
            dropped = np.bincount(doc[drop], minlength=b.num_rows).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n_lines - dropped)])
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines.filter(pa.array(~drop))), pa.scalar("\n", pa.large_string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines), pa.array(dropped), kept.cast(pa.string())], names=["id", "n_lines", "n_dropped", "text"])

    return run


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, n_lines, n_dropped, text): documents without the lines whose key is in ``frequent`` (h)."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, text string"
    if frequent.count() <= broadcast_keys:
        gone = spark.sparkContext.broadcast({bytes(r[0]) for r in frequent.toLocalIterator()})
        return narrow.mapInArrow(_cutter(gone, least_chars), schema)

    def pairs(parts):
        for b in small_batches(parts, AT_ONCE):
            doc, key, digests = _keys_by_text(b.column(1), least_chars)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), _taken(digests, key)], names=["row", "h"])

    # rows get a number of their own, written down with them
    narrow = materialize(narrow.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    hits = narrow.select("row", "text").mapInArrow(pairs, "row long, h binary").join(frequent, "h").groupBy("row").agg(F.collect_list("h").alias("gone"))
    return narrow.join(hits, "row", "left").select("id", "text", F.coalesce("gone", F.array().cast("array<binary>")).alias("gone")).mapInArrow(_cutter(None, least_chars), schema)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, least_chars: int = 1, batches: int = 4, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, n_lines, n_dropped, text): every document without the lines found in ``least`` documents or more. The table goes
    through the runs in ``batches`` batches; their number decides how much is counted at a time, not what goes."""
    spark = docs.sparkSession
    path = new_path(spark, "line-counts")
    counts = key_counts(docs, text_col, least_chars, batches)
    counts.write.partitionBy("batch").parquet(path)
    runs = LineRuns(spark, least)
    written = spark.read.schema(counts.schema).parquet(path)
    for k in range(batches):
        runs.add(written.filter(F.col("batch") == k).select("h", "docs"))
    frequent = runs.frequent()
    runs.close()
    delete(spark, path)
    return drop_lines(docs, frequent, id_col, text_col, least_chars, broadcast_keys).withColumnRenamed("id", id_col)


# the query ------------------------------------------------------------------------------------------------------------


def op11_line_runs(spark, sf_dir):
    return dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {"op11_line_runs": op11_line_runs}
SQL = {
    "op11_line_runs": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, {_KEY} AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, g.key IS NOT NULL AS drop FROM k LEFT JOIN gone g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT drop), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
}
