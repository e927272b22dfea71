"""Content-addressed store of token ids.

A store is a folder:

* ``chunks``: each distinct run of ids once, by its SHA-256: (digest, n, payload); payload is the ids as little-endian
  integers of ``WIDTH`` bytes where they fit and of four bytes otherwise (``wide``);
* ``recipes``: documents in ascending id order, in shards: (doc_id, n_tokens, crc (of all its ids, taken before they were
  cut), digests of its chunks in order, pid and pos (shard and place in it), start (ids of the documents before it in its
  shard));
* ``manifest``: a row for each shard: ids and documents before it, documents, and the root of a Merkle tree of fan-out
  ``FAN`` over all fields of its recipes; with the root over all rows of the manifest.

Chunks end where a rolling hash of the last ``SPAN`` ids has ``BITS`` zero bits, so that equal passages are cut alike in
whatever document they stand; they hold ``LEAST`` to ``MOST`` ids, the last one of a document may be shorter. A document
is tokenised once. Of equal chunks in a task only one leaves it (of the last ``SEEN`` at least), so a passage that a third
of the documents hold meets in one place as a few rows for each task.

``verify`` fails if any field of a recipe or of the manifest was changed. Whoever reads documents back verifies each chunk
by its digest, takes places from the lengths of the chunks, and fails where the ids that they come to are not those that
were written, by number and CRC.

A null or empty text is its end id alone. Texts are never cut but in chunks, however long; a very long one is a row with a
long list of digests. Null ids stand first; repeated rows are documents of their own. Columns other than id and text are
ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.ordered import running
from lectern.llm.staging import delete, new_path, table
from lectern.llm.tokens import default_path, encoder, small_batches, with_end

SPAN, BITS, LEAST, MOST = 16, 9, 64, 4096
WIDTH, FAN, SEEN = 2, 256, 500_000


def boundaries(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that stand one after another and end at ``ends``."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    k = 1
    while k < min(SPAN, len(h)):  # h[i] = sum of g[i - j] * c ** j over j < 2 * k, from the same over j < k
        h[k:] = h[k:] + h[:-k] * np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64))
        k *= 2
    marks = np.flatnonzero((h >> np.uint64(64 - BITS)) == 0) + 1
    out, at, k = [], 0, 0
    for end in ends.tolist():
        # a mark within the first LEAST (>= SPAN) ids of a document would depend on what stands before it
        while end - at > LEAST:
            k = int(np.searchsorted(marks, at + LEAST))
            nxt = int(marks[k]) if k < len(marks) else end
            at = min(nxt, at + MOST, end)
            out.append(at)
        if at < end:
            out.append(end)
            at = end
    return np.array(out, np.int64)


def _pack(ids: np.ndarray) -> tuple[bool, bytes]:
    wide = bool(len(ids)) and int(ids.max()) >= 1 << (8 * WIDTH)
    return wide, ids.astype("<u4" if wide else "<u2").tobytes()


def _cutter(path: str, end_id: int):
    def run(batches):
        enc, seen = encoder(path), set()
        for b in small_batches(batches):
            if len(seen) > SEEN:
                seen.clear()
            ids, counts = enc.encode(b.column(1))
            ids, counts, offs = with_end(ids, counts, end_id)
            crc = [zlib.crc32(ids[x:y]) for x, y in pairwise(offs.tolist())]
            cuts = boundaries(ids, offs[1:])
            digests, new = [], []
            for x, y in pairwise([0, *cuts.tolist()]):
                wide, data = _pack(ids[x:y])
                d = hashlib.sha256((b"w" if wide else b"n") + data).digest()
                digests.append(d)
                if d not in seen:
                    seen.add(d)
                    new.append((d, y - x, wide, data))
            per = np.searchsorted(cuts, offs, side="right")
            lists = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(digests, pa.binary()))
            n, m = b.num_rows, len(new)
            d, c, w, p = zip(*new, strict=True) if new else ((),) * 4
            none = lambda t, k: pa.nulls(k, t)
            both = lambda a, z, t: pa.concat_arrays([a.cast(t), z.cast(t)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([False, True], [n, m])),
                    both(b.column(0), none(pa.int64(), m), pa.int64()),
                    both(pa.array(counts), pa.array(c, pa.int64()), pa.int64()),
                    both(pa.array(crc, pa.int64()), none(pa.int64(), m), pa.int64()),
                    both(lists, none(pa.list_(pa.binary()), m), pa.list_(pa.binary())),
                    both(none(pa.binary(), n), pa.array(d, pa.binary()), pa.binary()),
                    both(none(pa.bool_(), n), pa.array(w, pa.bool_()), pa.bool_()),
                    both(none(pa.binary(), n), pa.array(p, pa.binary()), pa.binary()),
                ],
                names=["chunk", "doc_id", "n", "crc", "digests", "digest", "wide", "payload"],
            )

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> str:
    """Tokenise ``docs`` into a store at ``path``; returns ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    schema = "chunk boolean, doc_id long, n long, crc long, digests array<binary>, digest binary, wide boolean, payload binary"
    staged = new_path(spark, "cut")
    rows.mapInArrow(_cutter(tokenizer or default_path(), end_id), schema).write.option("compression", "zstd").parquet(staged)
    cut = spark.read.schema(schema).parquet(staged)
    unique = cut.filter("chunk").select("digest", F.col("n").cast("int").alias("n"), "wide", "payload").dropDuplicates(["digest"])
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = cut.filter("not chunk").select("doc_id", F.col("n").alias("n_tokens"), "crc", "digests", F.lit(1).cast("long").alias("one"))
    kept, before = running(recipes, ["doc_id", "n_tokens"], {"n_tokens": "start", "one": "pos"}, path=f"{path}/recipes")
    delete(spark, staged)
    bases = spark.createDataFrame([(b[0], b[1], b[2]) for b in before if b[0] is not None], "pid int, ids_before long, docs_before long")
    roots = shard_roots(kept).join(F.broadcast(bases), "pid")
    roots.withColumn("store_root", F.lit(_over(roots))).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def _over(manifest: DataFrame) -> str:
    """The root over all shards: a row for each shard comes to the driver."""
    h = hashlib.sha256()
    for r in manifest.select("pid", "root", "docs", "ids_before", "docs_before").orderBy("pid").collect():
        h.update("|".join(map(str, r)).encode() + b"\n")
    return h.hexdigest()


def shard_roots(recipes: DataFrame) -> DataFrame:
    """(pid, docs, root): a Merkle tree over each shard's recipes, level by level in groups of ``FAN``."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "n_tokens", "crc", "start", "pid", "pos")]
    leaf = F.sha2(F.concat_ws("|", *fields, F.array_join(F.transform("digests", lambda d: F.hex(d)), ",")), 256)
    level = recipes.select("pid", "pos", leaf.alias("h"))
    docs = recipes.groupBy("pid").agg(F.count("*").alias("docs"))
    most = docs.agg(F.max("docs")).first()[0] or 0
    while most > 0:
        level = level.groupBy("pid", F.floor(F.col("pos") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("k"))
        level = level.select("pid", F.col("up").alias("pos"), F.sha2(F.array_join(F.transform("k", lambda x: x["h"]), ""), 256).alias("h"))
        most = 0 if most <= FAN else -(-most // FAN)
    return level.select("pid", F.col("h").alias("root")).join(docs, "pid")


def verify(spark: SparkSession, path: str) -> None:
    """Fail unless every shard has the root that the manifest names, and the manifest the root over them."""
    told = spark.read.parquet(f"{path}/manifest")
    found = shard_roots(spark.read.parquet(f"{path}/recipes")).select("pid", F.col("root").alias("found"), F.col("docs").alias("docs_found"))
    wrong = told.join(found, "pid", "full_outer").filter(~(F.col("root").eqNullSafe(F.col("found")) & F.col("docs").eqNullSafe(F.col("docs_found")))).count()
    first = told.select("store_root").first()
    if wrong or (first and _over(told) != first[0]):
        raise ValueError(f"{path}: {wrong} shards do not have the roots that the manifest names")


def _ids(payload: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(payload, "<u4" if wide else "<u2").astype("<u4")


def _checked(payloads, wides, digests):
    """The ids of chunks; fails where stored bytes do not have the digest under which they are stored."""
    for p, w, d in zip(payloads, wides, digests, strict=True):
        if hashlib.sha256((b"w" if w else b"n") + p).digest() != d:
            raise ValueError(f"chunk {d.hex()} is damaged")
        yield _ids(p, w)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids from its chunks. A document is one row, as it was when it was read."""
    bases = F.broadcast(spark.read.parquet(f"{path}/manifest").select("pid", "ids_before"))
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")

    @F.pandas_udf("array<long>")
    def whole(parts: pd.Series, n_tokens: pd.Series, crc: pd.Series) -> pd.Series:
        out = []
        for x, n, c in zip(parts, n_tokens, crc, strict=True):
            ids = np.concatenate(list(_checked(*zip(*[(p["payload"], p["wide"], p["digest"]) for p in x], strict=True))))
            if len(ids) != n or zlib.crc32(ids) != c:
                raise ValueError("a document's chunks do not hold its ids")
            out.append(ids.astype(np.int64))
        return pd.Series(out)

    parts = recipes.select("pid", "pos", F.posexplode("digests").alias("i", "digest")).join(chunks, "digest")
    parts = parts.groupBy("pid", "pos").agg(F.sort_array(F.collect_list(F.struct("i", "payload", "wide", "digest"))).alias("x"))
    met = recipes.join(parts, ["pid", "pos"]).join(bases, "pid")
    return met.select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), whole("x", "n_tokens", "crc").alias("ids"))


def _powers() -> np.ndarray:
    """Column k: what each byte of a CRC-32 becomes behind 2**k zero bytes, as tables of 4 x 256."""
    poly = 0xEDB88320
    bit = np.array([1 << i for i in range(32)], np.uint32)
    one = bit.copy()
    for _ in range(8):  # one zero byte
        one = np.where(one & 1, (one >> 1) ^ np.uint32(poly), one >> 1).astype(np.uint32)
    out = []
    for _ in range(48):
        table_ = np.zeros((4, 256), np.uint32)
        for j in range(4):
            for i in range(8):
                table_[j, (np.arange(256) >> i) & 1 == 1] ^= one[8 * j + i]
        out.append(table_)
        one = _through(one, table_)
    return np.array(out)


def _through(crc: np.ndarray, table_: np.ndarray) -> np.ndarray:
    return table_[0][crc & 255] ^ table_[1][(crc >> 8) & 255] ^ table_[2][(crc >> 16) & 255] ^ table_[3][crc >> 24]


POWERS = _powers()


def behind(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32s moved to the left by ``zeros`` bytes: the CRC of a whole is the XOR of those of its parts, so moved."""
    out, left = crc.astype(np.uint32), zeros.astype(np.int64)
    for k in range(int(left.max(initial=0)).bit_length()):
        on = (left >> k) & 1 == 1
        out[on] = _through(out[on], POWERS[k])
    return out


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. Chunks are read and verified once each, however many documents
    hold them; what is moved to a document is a length and a CRC for each of its chunks, not its ids. From these its ids'
    number and CRC are put together in the order of the recipe, and must be what was written."""
    bases = F.broadcast(spark.read.parquet(f"{path}/manifest").select("pid", "ids_before"))
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")

    def facts(batches):
        for b in small_batches(batches):
            d, n, crc = b.column(0).to_pylist(), [], []
            for ids in _checked(b.column(2).to_pylist(), b.column(1).to_pylist(), d):
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    known = chunks.select("digest", "wide", "payload").mapInArrow(facts, "digest binary, m long, part long")
    parts = recipes.select("pid", "pos", "doc_id", "start", "n_tokens", "crc", F.posexplode("digests").alias("i", "digest")).join(known, "digest")
    parts = parts.groupBy("pid", "pos", "doc_id", "start", "n_tokens", "crc").agg(F.sort_array(F.collect_list(F.struct("i", "m", "part"))).alias("x"))
    rows = parts.join(bases, "pid").select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "crc", F.col("x.m").alias("m"), F.col("x.part").alias("part"))

    def whole(batches):
        for b in batches:
            lists, m = b.column(4), b.column(4).flatten().to_numpy()
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            upto = np.concatenate([[0], np.cumsum(m)])
            n = upto[cuts[1:]] - upto[cuts[:-1]]
            after = np.repeat(upto[cuts[1:]], np.diff(cuts)) - upto[1:]  # ids of the document behind each chunk
            moved = behind(b.column(5).flatten().to_numpy(), after * 4)
            crc = np.bitwise_xor.reduceat(moved, cuts[:-1]).astype(np.int64) if b.num_rows else np.zeros(0, np.int64)
            if (n != b.column(2).to_numpy()).any() or (crc != b.column(3).to_numpy()).any():
                raise ValueError("a document's chunks do not hold its ids")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


# the query ------------------------------------------------------------------------------------------------------------


def op7_token_store(spark, sf_dir):
    path = write(table(spark, sf_dir, "documents"), new_path(spark, "store"))
    verify(spark, path)
    return summaries(spark, path)


QUERIES = {"op7_token_store": op7_token_store}
SQL: dict[str, str] = {}
