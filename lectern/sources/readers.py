"""Scans with declared schemas. Bad records are kept apart, not dropped in silence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACHMENT = "struct<page_url:string,link_text:string,download_url:string,detected_at:string,type:string,status:string,minio_url:string,minio_object:string,filename:string,error:string>"
RAW_PAGE = (
    "doc_id string, source_type string, site string, board_name string, title string, display_title string, author string, url string, created_at string, updated_at string, has_explicit_date boolean, "
    f"view_count int, doc_type string, main_text string, text string, attachments array<{ATTACHMENT}>, images array<struct<src:string,alt:string>>, crawled_at string, "
    f"metadata struct<created_at:string,post_date:string,attachments:array<{ATTACHMENT}>>, _corrupt_record string"
)
CORPUS = "id string, url string, title string, text string, chunk_index int, total_chunks int, source string, domain string, attachments_count int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHUNK = "chunk_id string, doc_id string, chunk_index int, text string, metadata struct<site:string,board_name:string,title:string,url:string,created_at:string,tags:array<string>,source_type:string>, _corrupt_record string"


def json_pages(spark: SparkSession, path: str, schema: str = RAW_PAGE, glob: str = "*.json") -> DataFrame:
    """One object a file, in any folder below ``path``; unreadable ones have ``_corrupt_record``. Text and attachments are
    found in either of their places."""
    raw = _json(spark, path, schema, glob)
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return raw.withColumn("main_text", F.coalesce("main_text", "text")).withColumn("attachments", F.coalesce(full("attachments"), full("metadata.attachments")))


def _json(spark: SparkSession, path: str, schema: str, glob: str, whole: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, one object a file, with the file's name, by which they can be ordered; unreadable ones have ``_corrupt_record``."""
    return _json(spark, path, CHUNK, "*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def json_sets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Questions of an evaluation: a list of objects in a file, or an object a line (``.jsonl``)."""
    whole = not path.endswith(".jsonl")
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def point_text(df: DataFrame) -> DataFrame:
    """Stored points with their text, which stands in one of four columns; those without one go."""
    some = [c for c in ("chunk_text", "text", "main_text", "content") if c in df.columns]
    out = df.withColumn("__text", F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in some]))
    return out.filter(F.btrim("__text") != "").drop(*some).withColumnRenamed("__text", "text")


def corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Rows with a text that is not blank."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).filter(F.btrim("text") != "")


def headerless_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines that begin with an address, by position; what overflows belongs to the last column."""
    parts = F.split("value", ",", len(columns))
    rows = spark.read.text(path).filter(F.col("value").startswith("http"))
    return rows.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def crawl_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A crawl's table with or without a line of names: without one where the first line begins with an address."""
    first = spark.read.text(path).filter("value <> ''").first()
    if first is None or first[0].startswith("http"):
        return headerless_csv(spark, path, columns)
    names = [c.strip() for c in first[0].split(",")]
    df = spark.read.schema(", ".join(f"`{c}` string" for c in names)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in columns])


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of the ``url`` elements, each address once with its last date; http becomes https, no end slash."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    loc = F.regexp_replace(F.regexp_replace(F.btrim("loc"), "^http://", "https://"), "/$", "")
    return raw.select(loc.alias("loc"), "lastmod").filter(F.col("loc") != "").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def sitemaps(spark: SparkSession, start: str, locate=lambda loc: loc, sections: tuple[str, ...] = (), canonical=lambda loc: loc.strip()) -> DataFrame:
    """(loc, lastmod) of all addresses below an index of sitemaps. ``locate`` says where Spark finds a sitemap's file. Of an index only
    children of the allowed sections are followed, each once. The driver holds the list of sitemaps, not of addresses."""
    todo, seen, out = [start], set(), None
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        children = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(locate(at)).filter("loc is not null").collect()
        for r in children:
            loc = canonical(r["loc"])
            parts = [p for p in loc.split("://")[-1].split("/")[1:] if p]
            if loc and (not sections or (parts and parts[0] in sections)):
                todo.append(loc)
        if not children:
            part = sitemap(spark, locate(at)).withColumn("seq", F.lit(len(seen)))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "loc string, lastmod string")
    return out.groupBy("loc").agg(F.max_by("lastmod", "seq").alias("lastmod"))


#: Parts of addresses that are no plain pages, and endings of files.
NOT_STATIC = ("mode=", "articleNo=", "search", "Search", "login", "Login", "fileDownload", "fileDown", "download=", "board", "bbs", "reg.do")
FILE_ENDS = (".pdf", ".hwp", ".xls", ".xlsx", ".ppt", ".pptx", ".zip")


def static_pages(urls: DataFrame, prefix: str, exclude: DataFrame | None = None, column: str = "loc") -> DataFrame:
    """(loc): plain pages below ``prefix``, each once, without those to exclude."""
    u = F.regexp_replace(column, "^http://", "https://")
    df = urls.select(u.alias("u")).filter(F.startswith("u", F.lit(prefix)) & ~F.contains("u", F.lit("#")))
    for x in NOT_STATIC:
        df = df.filter(~F.contains("u", F.lit(x)))
    for x in FILE_ENDS:
        df = df.filter(~F.endswith(F.lower("u"), F.lit(x)))
    df = df.select(F.regexp_replace("u", "/+$", "").alias("loc")).distinct()
    return df if exclude is None else df.join(exclude.select(F.regexp_replace(column, "/+$", "").alias("loc")), "loc", "left_anti")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): lines that are not blank, numbered from 0 by file and place, however the files are read. A file of questions
    is one row until then."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.transform(F.split("value", r"\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "").alias("l"))
    sizes, before, at = sorted(whole.select("file", F.size("l")).collect()), {}, 0
    for f, n in sizes:
        before[f], at = at, at + n
    if not before:
        return spark.createDataFrame([], "query_id long, text string")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("file"))
    return whole.select(base.alias("b"), F.posexplode("l").alias("i", "text")).select((F.col("b") + F.col("i")).cast("long").alias("query_id"), "text")


def settings(spark: SparkSession, path: str) -> dict:
    """A small file of settings, JSON or (where a YAML library is there) YAML, read by Spark wherever it lies."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def targets(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Boards, menus and schedules to crawl as a table: name, url, kind."""
    return spark.createDataFrame([(r["name"], r["url"], r.get("kind", "board")) for r in rows], "name string, url string, kind string")


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, ext, length, content) of any files, also in an object store."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), "length", "content")
    return df.filter(F.col("ext").isin(*extensions)) if extensions else df


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, member, content, error) of the files in zip archives; names without the UTF-8 flag are Korean. A damaged archive or
    member is a row with an error and no content."""

    def run(batches):
        import io
        import zipfile
        import zlib

        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                row = lambda member, content, error, path=path: pa.RecordBatch.from_pylist([{"path": path, "member": member, "content": content, "error": error}], schema=schema)
                try:
                    z = zipfile.ZipFile(io.BytesIO(data or b""))
                except zipfile.BadZipFile as e:
                    yield row(None, None, str(e))
                    continue
                for m in z.infolist():
                    name = m.filename if m.flag_bits & 0x800 else m.filename.encode("cp437", "replace").decode("euc-kr", "replace")
                    if not m.is_dir() and "__MACOSX" not in name and not name.rsplit("/", 1)[-1].startswith("."):
                        try:
                            yield row(name, z.read(m), None)
                        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
                            yield row(name, None, str(e) or type(e).__name__)

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


def open_url(url: str, timeout: float = 20.0) -> tuple[int, dict[str, str], bytes]:
    """(status, headers in lower case, body) over the network."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


#: Answers of a server that are worth asking again.
AGAIN = (500, 502, 503, 504)


def fetch(urls: DataFrame, opener=open_url, cache: DataFrame | None = None, retries: int = 5, delay: float = 0.0, kinds: tuple[str, ...] = ("html", "xml")) -> DataFrame:
    """(url, status, content_type, name, content, error) of addresses. What the cache (url, content) has is not asked for; a server's
    passing errors are asked again with growing pauses; text of other kinds than ``kinds`` is left out if these are given.
    ``opener`` opens one address, over the network or by a browser that renders it."""

    def run(batches):
        import time

        import pyarrow as pa

        schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for b in batches:
            for url in b.column(0).to_pylist():
                row = {"url": url, "status": None, "content_type": None, "name": None, "content": None, "error": None}
                for n in range(retries + 1):
                    try:
                        status, headers, body = opener(url)
                    except Exception as e:  # noqa: BLE001  whatever the network does is the row's error
                        row["error"] = f"{type(e).__name__}: {e}"
                        break
                    kind = headers.get("content-type", "")
                    told = headers.get("content-disposition", "")
                    name = told.split("filename=")[-1].strip("\"'") if "filename=" in told else url.split("?")[0].rsplit("/", 1)[-1]
                    row |= {"status": status, "content_type": kind, "name": name}
                    if status not in AGAIN:
                        row["content"] = body if status == 200 and (not kinds or any(k in kind for k in kinds)) else None
                        break
                    time.sleep(delay * 2**n)
                if delay:
                    time.sleep(delay)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = "url string, status int, content_type string, name string, content binary, error string"
    todo = urls.select("url").distinct()
    if cache is None:
        return todo.mapInArrow(run, schema)
    hit = cache.join(todo, "url", "left_semi").select("url", F.lit(200).alias("status"), F.lit("cache").alias("content_type"), F.lit(None).cast("string").alias("name"), F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    return todo.join(cache, "url", "left_anti").mapInArrow(run, schema).unionByName(hit)


def robots(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(host, agent, allow, path, delay) of the lines of robots files (host, text). A rule belongs to the agents named before it."""
    def rules(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            agents, found, fresh = [], [], True
            for line in (text or "").splitlines():
                key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
                key = key.lower()
                if key == "user-agent":
                    agents = [value.lower()] if not fresh else [*agents, value.lower()]
                    fresh = True
                elif key in ("allow", "disallow", "crawl-delay"):
                    fresh = False
                    for a in agents:
                        if key == "crawl-delay":
                            found.append({"agent": a, "allow": None, "path": None, "delay": float(value) if value.replace(".", "", 1).isdigit() else None})
                        elif value:
                            found.append({"agent": a, "allow": key == "allow", "path": value, "delay": None})
            out.append(found)
        return pd.Series(out)

    parsed = texts.select("host", F.explode(F.pandas_udf(rules, "array<struct<agent:string,allow:boolean,path:string,delay:double>>")("text")).alias("r"))
    return parsed.select("host", "r.*")


def permitted(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """The rows with ``permitted`` and ``delay``: by the longest rule of the host whose path begins the address's, for this agent or else
    for any; allowed where there is none. Rules are joined by host after they are gathered, a row each host."""
    from lectern.functions.urls import host, path

    own = rules.withColumn("mine", F.contains(F.lit(agent.lower()), F.col("agent")) & (F.col("agent") != "*")).filter(F.col("mine") | (F.col("agent") == "*"))
    sets = own.groupBy("host").agg(F.collect_list(F.struct("mine", "allow", "path", "delay")).alias("rules"), F.max("mine").alias("named"))
    df = urls.withColumn("__h", host(url)).join(sets.withColumnRenamed("host", "__h"), "__h", "left")
    fits = F.filter("rules", lambda r: (r["mine"] == F.col("named")) & r["path"].isNotNull() & F.startswith(path(url), F.regexp_replace(r["path"], r"[*$].*$", "")))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))["allow"]
    delay = F.array_max(F.transform(F.filter("rules", lambda r: r["mine"] == F.col("named")), lambda r: r["delay"]))
    return df.select(*urls.columns, F.coalesce(best, F.lit(True)).alias("permitted"), F.coalesce(delay, F.lit(0.0)).alias("delay"))
