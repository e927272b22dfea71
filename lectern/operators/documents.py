"""From raw records of a crawl to unified documents, and from their attachments to documents of their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import urls
from lectern.operators.tables import keep_first, latest

#: Endings of attachments that can be documents, and the words of their documents.
ATTACHED = ("pdf", "hwp", "jpg", "jpeg", "png", "bmp", "gif")
PICTURES = ("jpg", "jpeg", "png", "bmp", "gif")
ATTACHED_TITLE, ATTACHED_TAG, ORIGIN = "[첨부파일] ", "첨부파일", " (출처: "
NO_TITLE, NO_BOARD = "제목 없음", "첨부파일"
#: Texts of attachments are at least so long; shorter ones of a PDF are read from its pictures.
LEAST, LEAST_PDF = 5, 50


def site_and_board(title: Column, url: Column) -> Column:
    """Site and board: the title's parts between bars, the first and the rest; what it lacks from the path's first two parts."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\|"), lambda s: tx.trim(s)), lambda s: s != "")
    steps = urls.path_parts(F.coalesce(url, F.lit("")))
    board = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " | "))
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.get(steps, F.lit(0))).alias("site"), F.coalesce(board, F.get(steps, F.lit(1))).alias("board_name"))


def unify_raw(raw: DataFrame) -> DataFrame:
    """Raw records (``sources.readers.RAW_PAGE``) to unified documents, one select over the text's lines: key, site and board, title,
    head of the post, date, cleaned text, a schedule's rows as sentences, attachments of either place."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    df = raw.withColumn("__t", F.coalesce(tx.blank_to_null("main_text"), F.col("text"), F.lit(""))).withColumn("__h", tx.post_header("__t"))
    df = df.withColumn("__w", site_and_board(tx.first_filled("metadata.title", "title"), F.col("url")))
    df = df.withColumn("__d", urls.best_date("created_at", "metadata.created_at", "metadata.post_date", "__h.created_at"))
    df = df.withColumn("__title", F.coalesce(tx.blank_to_null("title"), F.get(tx.solid_lines("__t"), F.lit(0)))).withColumn("__main", tx.clean_post("__t"))
    df = df.withColumn("__told", tx.schedule_sentences("__main", "url", "__w.board_name", "__title"))
    return df.select(
        urls.doc_id("url").alias("doc_id"), F.lit("board").alias("source_type"), F.col("__w.site").alias("site"), F.col("__w.board_name").alias("board_name"), F.col("__title").alias("title"),
        F.col("__title").alias("display_title"), F.col("__h.author").alias("author"), "url", F.date_format("__d", "yyyy-MM-dd").alias("created_at"), F.col("__d").isNotNull().alias("has_explicit_date"),
        F.col("__h.view_count").alias("view_count"), F.lit("html").alias("doc_type"), F.col("__told").alias("main_text"), F.coalesce(full("attachments"), full("metadata.attachments")).alias("attachments"),
        tx.blank_to_null(F.coalesce("metadata.crawled_at", "crawled_at")).alias("crawled_at"), F.struct(F.col("metadata.text_length").alias("text_length"), F.col("title").alias("raw_title")).alias("source_meta"),
        tx.schedule_tags(F.lit(None).cast("array<string>"), "__main", "__told").alias("tags"),
    )


def page_documents(pages: DataFrame, kind: str | Column = "page") -> DataFrame:
    """Pages (url, title, text, images) as documents by the crawl's own keys; pages of pictures only are of a type of their own."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    df = pages.select("*", urls.page_key("url", kind).alias("doc_id"), urls.site_code("url").alias("site"), F.when(kind == "board_notice", "board").otherwise("page").alias("source_type"))
    bare = (F.coalesce("text", F.lit("")) == "") & (F.size("images") > 0) & (kind != "board_notice")
    return df.withColumn("doc_type", F.when(bare, "image_html").otherwise("html")).withColumn("text_length", F.length(F.coalesce("text", F.lit("")))).withColumn("word_count", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "")))


def legacy(pages: DataFrame, source: Column) -> DataFrame:
    """Older records in one form: fields that lack are empty, domain and source are told, attachments counted."""
    some = F.size("attachments") > 0
    return pages.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "text")], "crawled_at", urls.host("url").alias("domain"), source.alias("source"),
        F.when(some, F.col("attachments")).alias("attachments"), F.when(some, F.size("attachments")).alias("attachments_count"),
    )


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``old`` has otherwise or not at all."""
    cols = [c for c in new.columns if c != key]
    was = old.select(key, F.struct(*cols).alias("__was"))
    return new.join(was, key, "left").filter(~F.struct(*cols).eqNullSafe(F.col("__was"))).select(*new.columns)


def page_info(docs: DataFrame) -> DataFrame:
    """A document's row in the crawl's index."""
    return docs.select("url", "title", F.length("text").alias("text_length"), "crawled_at", F.coalesce(F.size("attachments"), F.lit(0)).alias("attachments_count"))


# attachments ------------------------------------------------------------------------------------------------------------


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def exploded(docs: DataFrame) -> DataFrame:
    """A row for each attachment of each document that has a stored object of a kind that can be read, the parent's fields with it."""
    rows = docs.select(F.struct("title", "url", "board_name", "created_at").alias("parent"), F.explode("attachments").alias("a"))
    rows = rows.select("parent", F.col("a.minio_object").alias("object"), F.coalesce("a.filename", F.lit("unknown")).alias("filename"))
    rows = rows.withColumn("ext", extension(F.when(F.contains("object", F.lit(".")), F.col("object")).otherwise(F.col("filename"))))
    return rows.filter(F.col("object").isNotNull() & F.col("ext").isin(*ATTACHED))


def fetched(attached: DataFrame, objects: DataFrame) -> DataFrame:
    """The attachments with the content of their object (``objects``: object, content), or that of its name without what stands
    behind the last low line of its stem. Those without either go. Two joins by name; the second takes what is left over."""
    found = attached.join(objects, "object")
    rest = attached.join(objects.select("object"), "object", "left_anti").filter(F.col("object").rlike(r"_[^/_]*\.[^./]*$"))
    bare = rest.withColumn("__o", F.regexp_replace("object", r"_[^/_]*(\.[^./]*)$", "$1")).join(objects.withColumnRenamed("object", "__o"), "__o").drop("__o")
    return found.unionByName(bare.select(*found.columns))


def extracted(content: Column, ext: Column, extractors: dict[str, Callable[[Column], Column]], ocr: Callable[[Column], Column] | None = None) -> Column:
    """Text by file ending. ``extractors``: ending -> function of the content; ``ocr`` reads pictures, and PDFs of which less than
    ``LEAST_PDF`` characters come. Other endings have none."""
    out = F.lit(None).cast("string")
    for e, f in extractors.items():
        out = F.when(ext == e, f(content)).otherwise(out)
    if ocr is not None:
        scanned = (ext == "pdf") & (F.length(tx.trim(F.coalesce(out, F.lit("")))) < LEAST_PDF)
        out = F.when(ext.isin(*PICTURES) | scanned, ocr(content)).otherwise(out)
    return out


def plain_text(content: Column) -> Column:
    """A text file's text: UTF-8 if it is that, or else the Korean code page."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(decoded(content))


def decoded(content: Column) -> Column:
    """Text of unknown encoding: by a mark at its start, as UTF-8, by a declared charset, as one of the Korean or Western code pages,
    whichever fits first."""
    def one(raw: bytes | None) -> str | None:
        import codecs
        import re

        if raw is None:
            return None
        for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
            if raw.startswith(mark):
                return raw.decode(name, "ignore")
        said = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", raw[:4096])
        for name in ["utf-8", *([said[1].decode()] if said else []), "cp949", "cp1252"]:
            try:
                return raw.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
        return raw.decode("utf-8", "ignore")

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(content)


def attachment_documents(attached: DataFrame) -> DataFrame:
    """Attachments with their text (parent, object, filename, ext, content_text) as documents that inherit from their parents: each
    object once, texts of at least ``LEAST`` characters."""
    rows = attached.filter(F.length(tx.trim("content_text")) >= LEAST)
    p = lambda c, other: F.coalesce(F.col(f"parent.{c}"), other)
    out = rows.select(
        F.concat(F.lit("att_"), F.left(F.md5("object"), F.lit(16))).alias("doc_id"), F.lit("attachment").alias("source_type"), F.lit("attachment").alias("site"), p("board_name", F.lit(NO_BOARD)).alias("board_name"),
        F.concat(F.lit(ATTACHED_TITLE), "filename").alias("title"), F.concat("filename", F.lit(ORIGIN), p("title", F.lit(NO_TITLE)), F.lit(")")).alias("display_title"), p("url", F.lit("")).alias("url"),
        F.col("parent.created_at").alias("created_at"), F.col("content_text").alias("main_text"), F.col("ext").alias("doc_type"), F.array(F.lit(ATTACHED_TAG), F.upper(F.concat(F.lit("."), "ext"))).alias("tags"),
        F.col("filename").alias("original_filename"), F.col("parent.title").alias("parent_title"),
    )
    return keep_first(out, ["doc_id"], ["url", "title"])


def with_attachments(docs: DataFrame, attached: DataFrame) -> DataFrame:
    """Pages and attachments as one corpus."""
    return docs.unionByName(attached, allowMissingColumns=True)


def members_on_pages(members: DataFrame, pages: DataFrame) -> DataFrame:
    """Members of archives (archive, member, content) with every page that refers to the archive (archive, url, title)."""
    return members.join(pages, "archive")


def members_by_name(members: DataFrame, attached: DataFrame) -> DataFrame:
    """Members (member, ...) with the last page (seq) that has an attachment of that file name (name, url, seq)."""
    last = latest(attached, ["name"], ["seq"])
    return members.withColumn("name", F.element_at(F.split("member", "/"), -1)).join(last, "name")


def best_address(old: Column) -> Column:
    """Where a saved page came from: its canonical address, or what it says for sharing, or a snapshot's link, or its base."""
    return tx.first_filled(old["canonical"], old["og_url"], old["snapshot_link"], old["base"])


def excluded(path: Column, title: Column, path_patterns: list[str], title_phrases: list[str]) -> Column:
    """Whether a page's path matches a pattern or its title holds a phrase."""
    out = F.lit(False)
    for p in path_patterns:
        out = out | path.rlike(p)
    for t in title_phrases:
        out = out | F.contains(title, F.lit(t))
    return F.coalesce(out, F.lit(False))


def with_payload(chunks: DataFrame) -> DataFrame:
    """What a vector store keeps beside a chunk's vector; the attachment's name and parent are carried through."""
    have = set(chunks.columns)
    wanted = ("chunk_id", "doc_id", "chunk_index", "text", "site", "board_name", "title", "url", "created_at", "tags", "source_type", "file_name", "parent_title")
    return chunks.select("chunk_id", F.struct(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in wanted]).alias("payload"))


def merged_pages(pages: DataFrame, seen: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """Pages of another crawl that are not known yet, with a key of their address, fields in one form. ``by``: what a page is known by,
    its address if nothing else; of rows that agree in it the first crawled stays."""
    new = pages.join(seen.select(*by), list(by), "left_anti")
    return keep_first(new.withColumn("key", F.left(F.md5("url"), F.lit(16))).withColumn("title", F.coalesce("title", F.lit(""))).withColumn("text", F.coalesce("text", F.lit(""))), list(by), ["crawled_at"])
