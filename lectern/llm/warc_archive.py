"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables:

* ``headers``: a row per record with the digest of its payload and its exact header bytes (WARC fields and the HTTP head of
  its block), nothing else;
* ``payloads``: each distinct payload once, by its SHA-256, which is verified when it is read.

``records`` joins the two and so gives back the bytes of every record; ``parsed`` takes what it says of a record from these
bytes, and fails where a length, a digest or a field in them is not right. ``export_warc`` writes the same records as
ordinary WARC files, a gzip member each, and ``import_warc`` reads such files.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes that with the largest id is the response and the others
are revisits (identical-payload-digest profile); smaller ones are all responses. A null payload is an empty one. Records
with a null id are responses, and have no ``Row-ID``. Repeated rows (same id, same payload) give a record each, of one type
but with ids of their own; a revisit refers to one of them. Payloads of any length are one value each, as they were in the
input. Columns other than id, url and payload are ignored. An empty table gives an empty archive.

Payload bytes are shuffled once, by (digest, record), which no popular payload makes uneven; what is joined by digest alone
is a few narrow columns, and Spark splits uneven partitions there.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.staging import materialize, new_path, table

MIN_REVISIT = 1000
#: Records in a WARC file at most, so that one task can read it.
RECORDS_A_FILE = 2000

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _header(date: str) -> Column:
    """WARC fields and HTTP head; the payload, if any, follows them."""
    head = F.format_string(HTTP_HEAD, F.col("payload_bytes"))
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise("")
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <"), "urn",
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "sha1", F.lit("\r\n"), F.coalesce(F.concat(F.lit("Row-ID: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), head,
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> str:
    """Archive a record for each row of ``pages``, whose ids are numbers; returns ``path``."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = keyed.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.concat(F.lit("urn:uuid:"), F.expr("uuid()")).alias("urn"))
    narrow = materialize(narrow, "records")  # a record's id is drawn once
    best = narrow.groupBy("digest").agg(F.max(F.struct("id", "urn")).alias("best"))
    revisit = (F.col("payload_bytes") >= min_revisit) & (F.col("id") < F.col("best.id"))
    headers = narrow.join(best, "digest").withColumn("refers_to", F.when(revisit, F.col("best.urn")))
    headers.select("digest", _header(date).cast("binary").alias("header")).write.parquet(f"{path}/headers")
    _one_each(keyed, best.select("digest", F.col("best.id").alias("best"))).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _one_each(keyed: DataFrame, best: DataFrame) -> DataFrame:
    """The payload of one row for each digest. Both steps need rows by (digest, name), so the payloads move once."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    met = keyed.select("digest", name("id").alias("name"), "payload").join(best.select("digest", name("best").alias("name")), ["digest", "name"], "left_semi")
    return met.dropDuplicates(["digest", "name"]).select("digest", "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): the bytes of each WARC record without the two line ends behind it, and its payload, also that of a
    revisit, whose record leaves it out. The read fails where stored bytes do not have the digest under which they are
    stored."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest"))
    found = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    revisit = F.startswith(F.col("header").cast("string"), F.lit(f"{VERSION}\r\nWARC-Type: revisit\r\n"))
    return headers.join(found, "digest").select(F.when(revisit, F.col("header")).otherwise(F.concat("header", "payload")).alias("record"), "payload")


def parsed(records_: DataFrame) -> DataFrame:
    """Per record (record, payload): id, urn, record_type, refers_to (a urn), url, payload_bytes, payload_digest, payload. All
    but the payload is read from the record's bytes; the read fails where they contradict themselves or the payload."""
    text = F.col("record").cast("string")  # bytes as they are; the functions below look for bytes
    df = records_.select("record", "payload", F.substring_index(text, END, 1).alias("warc"), F.substring_index(text, END, 2).alias("heads"))
    df = df.select("record", "payload", "warc", "heads", F.str_to_map(F.col("warc"), F.lit("\r\n"), F.lit(": ")).alias("f"))
    df = df.withColumn("http", F.str_to_map(F.substring(F.encode("heads", "UTF-8"), F.octet_length("warc") + len(END) + 1, F.lit(1 << 30)).cast("string"), F.lit("\r\n"), F.lit(": ")))
    df = df.withColumn("body", F.octet_length("record") - F.octet_length("heads") - len(END))
    bytes_, digest = F.try_element_at("http", F.lit("Content-Length")).try_cast("long"), F.regexp_extract(F.try_element_at("f", F.lit("WARC-Payload-Digest")), "^sha1:([0-9a-f]{40})$", 1)
    field = lambda x: F.try_element_at("f", F.lit(x))
    kind, refers = field("WARC-Type"), F.btrim(field("WARC-Refers-To"), F.lit("<>"))
    right = (
        (F.octet_length("record") - F.octet_length("warc") - len(END) == field("Content-Length").try_cast("long"))
        & (F.octet_length("payload") == bytes_) & (F.sha1("payload") == digest)
        & F.when(kind == "response", F.col("body") == bytes_).when(kind == "revisit", (F.col("body") == 0) & refers.isNotNull())
    )
    sure = lambda c: F.when(F.coalesce(right, F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("not a right record: "), F.left("warc", F.lit(200)))).cast("string"))
    return df.select(field("Row-ID").cast("long").alias("id"), F.btrim(field("WARC-Record-ID"), F.lit("<>")).alias("urn"), sure(kind).alias("record_type"), refers.alias("refers_to"), field("WARC-Target-URI").alias("url"), bytes_.alias("payload_bytes"), digest.alias("payload_digest"), "payload")


def export_warc(spark: SparkSession, path: str, out: str, records_a_file: int = RECORDS_A_FILE) -> None:
    """The archive as WARC files of gzip members, one for each record, so that each can be read by itself. Spark's text writer
    puts bytes down as they are; what it must write behind each is an empty member, which adds nothing."""

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x + END.encode(), 6, mtime=0) for x in b.column(0).to_pylist()], pa.binary())], names=["value"])

    members = records(spark, path).select("record").mapInArrow(packed, "value binary").select(F.col("value").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", gzip.compress(b"", mtime=0).decode("latin-1")).option("maxRecordsPerFile", records_a_file).text(out)


def parse(chunks):
    """(header fields, block) for each record of a stream of bytes."""
    buf = b""
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        nonlocal buf
        parts = [buf]
        size = len(buf)
        while size < n and (c := next(chunks, None)) is not None:
            parts.append(c)
            size += len(c)
        buf = b"".join(parts)
        return len(buf) >= n

    while True:
        end = buf.find(b"\r\n\r\n")
        while end < 0 and fill(len(buf) + 1):
            end = buf.find(b"\r\n\r\n")
        if end < 0:
            if buf.strip():
                raise ValueError("a record without an end of its header")
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buf[:end].decode().lstrip("\r\n").split("\r\n")[1:])}
        size = int(fields["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("a record's block is cut off")
        yield fields, buf[end + 4 : end + 4 + size]
        buf = buf[end + 4 + size :].lstrip(b"\r\n")


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, with gzip or without: urn, record_type, refers_to (a urn), url, head, payload. A payload whose SHA-1 is not the declared one fails the read."""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column(0):
                raw = memoryview(data.as_buffer())
                chunks = _unzipped(raw) if bytes(raw[:2]) == b"\x1f\x8b" else (bytes(raw[i : i + (1 << 20)]) for i in range(0, len(raw), 1 << 20))
                out, held = [], 0
                for f, block in parse(chunks):
                    m = re.search(rb"\r\n\r\n", block) if f.get("content-type", "").startswith("application/http") else None
                    head, payload = (block[: m.end()], block[m.end() :]) if m else (b"", block)
                    told = f.get("warc-payload-digest", "")
                    if f["warc-type"] == "response" and told.startswith("sha1:") and told[5:] != hashlib.sha1(payload).hexdigest():
                        raise ValueError(f"{f['warc-record-id']}: the payload does not match its digest")
                    out.append({"urn": f["warc-record-id"].strip("<>"), "record_type": f["warc-type"], "refers_to": f.get("warc-refers-to", "").strip("<>") or None, "url": f.get("warc-target-uri"), "sha1": told[5:] or None, "head": head, "payload": payload})
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    import pyarrow as pa

    arrow = pa.schema([*[(x, pa.string()) for x in ("urn", "record_type", "refers_to", "url", "sha1")], ("head", pa.binary()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "urn string, record_type string, refers_to string, url string, sha1 string, head binary, payload binary")


def _unzipped(raw: memoryview):
    """The bytes of one or several gzip members, a megabyte of input at a time."""
    z = zlib.decompressobj(31)
    for i in range(0, len(raw), 1 << 20):
        part = bytes(raw[i : i + (1 << 20)])
        while part:
            yield z.decompress(part)
            part = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


# the query ------------------------------------------------------------------------------------------------------------


def described(spark: SparkSession, path: str) -> DataFrame:
    """What the records that are read back say of themselves: page_id, payload_bytes, payload_digest, record_type, refers_to (the
    response's page_id)."""
    found = materialize(parsed(records(spark, path)).drop("payload", "url"), "parsed")
    responses = found.filter("record_type = 'response'").select(F.col("urn").alias("refers_to"), F.col("id").alias("of"))
    met = found.filter("record_type = 'revisit'").join(responses, "refers_to", "left")
    lost = F.raise_error(F.concat(F.lit("no response has the id "), "refers_to")).cast("long")
    revisits = met.select("id", "payload_bytes", "payload_digest", "record_type", F.coalesce("of", lost).alias("refers_to"))
    out = found.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*revisits.columns).unionByName(revisits)
    return out.withColumnRenamed("id", "page_id")


def op4_content_addressed_warc(spark, sf_dir):
    return described(spark, write(table(spark, sf_dir, "pages"), new_path(spark, "archive")))


QUERIES = {"op4_content_addressed_warc": op4_content_addressed_warc}
SQL = {
    "op4_content_addressed_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id < best THEN best END AS refers_to
FROM d"""
}
