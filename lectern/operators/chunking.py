"""Chunkers: recursive splitting, windows snapped back to a sentence's end, windows stretched to the next one.

Each depends on where the chunk before ended, so they run on Arrow batches, a text at a time, and give (idx, text, start,
end) per chunk; null and blank texts give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.slices import sliced

SCHEMA = "array<struct<idx:int,text:string,start:int,end:int>>"


def windows(text: str, size: int = 1000, overlap: int = 150, least: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``size``; one that ends in its second half at a sentence's end is cut there, the next goes back ``overlap``."""
    n = len(text)
    if n <= size:
        return [(0, n)] if text.strip() and n >= least else []
    out, at = [], 0
    while True:
        end = at + size
        if end < n:
            stop = max(text.rfind(c, at, end) for c in ".!?。")
            if stop - at > size * 0.5:
                end = stop + 1
        if (part := text[at:end].strip()) and len(part) >= least:
            out.append((at, min(end, n)))
        at = end - overlap
        if at <= 0 or at >= n:
            return out


def stretched(text: str, size: int = 800, overlap: int = 100, reach: int = 200) -> list[tuple[int, int]]:
    """Spans of ``size`` stretched by up to ``reach`` to the next sentence's end. Of spans under 100 only a last one of 40 or more counts."""
    n, at, out = len(text), 0, []
    while at < n:
        near = [k for k in (text.find(c, min(n, at + size), min(n, at + size) + reach) for c in ".!?。\n") if k >= 0]
        end = min(near) + 1 if near else min(n, at + size)
        short = end - at < 100
        if not short or (end >= n and end - at >= 40):
            out.append((at, end))
        if end >= n:
            return out
        at = end if short else max(0, end - overlap)
    return out


def recursive(text: str, size: int = 1000, overlap: int = 200, seps: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces at the coarsest separator that occurs, merged up to ``size`` with ``overlap``; a piece that is too long is split by the next."""
    k = next((i for i, s in enumerate(seps) if s == "" or s in text), len(seps) - 1)
    sep, rest = seps[k], seps[k + 1 :]
    cut = text.split(sep) if sep else list(text)
    pieces = [p for p in ([cut[0], *[sep + p for p in cut[1:]]] if sep else cut) if p]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in pieces:
        if len(p) >= size and rest:
            flush()
            held, total = [], 0
            out += recursive(p, size, overlap, rest)
            continue
        if held and total + len(p) > size:
            flush()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    flush()
    return out


def chunk_column(text: Column, kind: str = "windows", **kw) -> Column:
    """An array of chunks. ``kind``: windows, stretched or recursive (whose chunks have no offsets)."""
    if kind == "recursive":

        def run(texts: list) -> list:
            return [[{"idx": i, "text": c, "start": None, "end": None} for i, c in enumerate(recursive(t or "", **kw))] for t in texts]

    else:
        f = {"windows": windows, "stretched": stretched}[kind]

        def run(texts: list) -> list:
            return [[{"idx": i, "text": t[a:b].strip() if kind == "windows" else t[a:b], "start": a, "end": b} for i, (a, b) in enumerate(f(t, **kw))] for t in (x or "" for x in texts)]

    return sliced(run, SCHEMA)(text)


def chunk(docs: DataFrame, text: str = "text", key: str = "doc_id", kind: str = "windows", **kw) -> DataFrame:
    """A row per chunk: chunk_id ({key}__{idx}), chunk_index, total_chunks, the chunk's text and offsets, and the document's other columns."""
    cols = [c for c in docs.columns if c != text]
    rows = docs.withColumn("__c", chunk_column(F.col(text), kind, **kw)).select(*cols, F.size("__c").alias("total_chunks"), F.explode("__c").alias("c"))
    return rows.select(F.concat_ws("__", F.col(key).cast("string"), F.col("c.idx").cast("string")).alias("chunk_id"), *cols, F.col("c.idx").alias("chunk_index"), "total_chunks", F.col("c.text").alias("text"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))


def with_header(text: Column, fields: dict[str, Column]) -> Column:
    """Label lines, an empty line, and the text; fields that are null are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()], F.lit(""), text)
