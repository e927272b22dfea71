"""Texts put right and parted: wrong decodings undone, words as chains of pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import mojibake
from lectern.operators import segments
from lectern.plans import query
from lectern.sources.readers import table
from lectern.sources.shared import staged


def broken(text: str | None, way: int) -> str | None:
    """A text as it is, or misread in one of four ways; the second is misread twice, and the fourth by a code page of its own."""
    if text is None or way == 0:
        return text
    once = mojibake.misread(text, ("cp1252", "cp1252", "latin-1", "mac_roman")[way - 1])
    return mojibake.misread(once, "cp1252") if way == 2 else once


@query("SELECT doc_id, doc_id % 5 AS way, md5(text) AS text FROM documents")
def repaired_texts(spark, d) -> DataFrame:
    """Documents misread in four ways, one in five left whole, all as they were before."""
    docs = table(spark, d, "documents")
    model = mojibake.fit(docs, longer=False)
    bad = F.pandas_udf(lambda t, w: pd.Series([broken(x, y) for x, y in zip(t, w, strict=True)]), "string")
    rows = docs.select("doc_id", (F.col("doc_id") % 5).alias("way"), bad("text", F.col("doc_id") % 5).alias("text"))
    return rows.select("doc_id", "way", F.md5(mojibake.repaired(F.col("text"), model)).alias("text"))


_WORDS = r"SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g')), '\s+'), lambda w: w <> '')) AS word FROM documents"


@query(f"SELECT count(DISTINCT word) AS words, count(*) AS occurrences, true AS rises, true AS whole FROM ({_WORDS})")
def learned_pieces(spark, d) -> DataFrame:
    """A lexicon of pieces learned from all words: its likelihood rises, and every word's pieces are the word."""
    words = segments.word_counts(table(spark, d, "documents"))
    lexicon, told = segments.train(words, rounds=3)
    rises = all(b >= a - 1e-6 * abs(a) for a, b in zip(told, told[1:], strict=False))
    parted = staged(segments.spread(words).withColumn("pieces", segments.morphemes(F.col("word"), lexicon)), "parted")
    return parted.agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"), F.lit(rises).alias("rises"), F.every(F.array_join("pieces", "") == F.col("word")).alias("whole"))


_WAYS = ("utf-8", "cp1252", "utf-16-le", "utf-16-be", "mac_roman", "cp437")


def encoded(text: str | None, way: int) -> bytes | None:
    """A text's bytes; UTF-8 where the encoding lacks a character."""
    if text is None:
        return None
    try:
        return text.encode(_WAYS[way])
    except UnicodeEncodeError:
        return text.encode()


@query("SELECT doc_id, doc_id % 6 AS way, md5(text) AS text FROM documents WHERE strlen(text) >= 200")
def detected_encodings(spark, d) -> DataFrame:
    """Documents of 200 bytes and more in six encodings by turns, read without being told which."""
    docs = table(spark, d, "documents").filter(F.octet_length("text") >= 200)
    model = mojibake.fit(docs)
    made = F.pandas_udf(lambda t, w: pd.Series([encoded(x, y) for x, y in zip(t, w, strict=True)]), "binary")
    rows = docs.select("doc_id", (F.col("doc_id") % 6).alias("way"), made("text", F.col("doc_id") % 6).alias("content"))
    return rows.select("doc_id", "way", F.md5(mojibake.decoded(F.col("content"), model)["text"]).alias("text"))
