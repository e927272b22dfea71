"""Queries that write tables by the sinks and read them by the sources, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import urls
from lectern.operators import documents
from lectern.plans import query
from lectern.sources import readers, writers
from lectern.sources.readers import table
from lectern.sources.shared import new_path


@query("""SELECT 'b' || item_id AS doc_id, text AS main_text, CASE WHEN item_id % 2 = 0 THEN 'http://h/' || item_id END AS url, (item_id % 3 = 0) AS attached FROM benchmark""")
def json_records(spark, d) -> DataFrame:
    """Items as JSON objects, one a file in folders, read as raw pages: text and attachments in either place."""
    b, path = table(spark, d, "benchmark"), new_path(spark, "json")
    even = F.col("item_id") % 2 == 0
    att = F.when(F.col("item_id") % 3 == 0, F.array(F.struct(F.lit("f.pdf").alias("filename"))))
    out = b.select("item_id", F.concat(F.lit("b"), "item_id").alias("doc_id"), F.when(even, F.col("text")).alias("main_text"), F.when(~even, F.col("text")).alias("text"), F.when(even, F.concat(F.lit("http://h/"), "item_id")).alias("url"), F.when(even, att).alias("attachments"), F.struct(F.when(~even, att).alias("attachments")).alias("metadata"))
    out.write.partitionBy("item_id").json(path)
    return readers.json_pages(spark, path).select("doc_id", "main_text", "url", F.coalesce(F.size("attachments") > 0, F.lit(False)).alias("attached"))


@query("""SELECT item_id || '__0' AS chunk_id, text, item_id % 5 AS tag FROM benchmark""")
def json_chunks(spark, d) -> DataFrame:
    """Chunks as JSON objects, one a file."""
    b, path = table(spark, d, "benchmark"), new_path(spark, "chunks")
    b.select("item_id", F.concat("item_id", F.lit("__0")).alias("chunk_id"), "text", F.struct(F.array((F.col("item_id") % 5).cast("string")).alias("tags")).alias("metadata")).write.partitionBy("item_id").json(path)
    return readers.json_chunks(spark, path).select("chunk_id", "text", F.get("metadata.tags", F.lit(0)).cast("long").alias("tag"))


@query("""SELECT doc_id::VARCHAR AS id, md5(text) AS text, source, (doc_id % 7)::INT AS chunk_index FROM documents WHERE trim(text) <> ''""")
def corpus_files(spark, d) -> DataFrame:
    """Documents as CSV and back; quotes and line ends stay, blank texts go."""
    t, path = table(spark, d, "documents"), new_path(spark, "corpus")
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    out = t.select(F.col("doc_id").cast("string").alias("id"), none("url"), none("title"), "text", (F.col("doc_id") % 7).cast("int").alias("chunk_index"), none("total_chunks", "int"), "source", none("domain"), none("attachments_count", "int"))
    writers.corpus_csv(out, path)
    return readers.corpus_csv(spark, path).select("id", F.md5("text").alias("text"), "source", "chunk_index")


@query(r"""SELECT regexp_replace(replace(regexp_extract(url, '^[^?#]*', 0), 'http://', 'https://'), '/$', '') AS loc, max(lpad(page_id::VARCHAR, 6, '0')) AS lastmod FROM pages GROUP BY 1""")
def sitemap_files(spark, d) -> DataFrame:
    """Addresses of pages as a sitemap for each host and back, each once with its last date."""
    p, path = table(spark, d, "pages"), new_path(spark, "map")
    item = F.concat(F.lit("<url><loc> "), F.regexp_extract("url", "^[^?#]*", 0), F.lit(" </loc><lastmod>"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("</lastmod></url>"))
    maps = p.groupBy(urls.host("url")).agg(F.array_join(F.collect_list(item), "\n").alias("u"))
    maps.select(F.concat(F.lit("<urlset>"), "u", F.lit("</urlset>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.sitemap(spark, path)


@query("""SELECT url, title, text FROM (SELECT 'http://h/' || item_id AS url, 'T' || item_id AS title, 'a,' || left(regexp_replace(text, '[\\s,]+', ' ', 'g'), 20) || ',b' AS text FROM benchmark)""")
def headerless_files(spark, d) -> DataFrame:
    """Lines without names: by position, what overflows belongs to the last."""
    b, path = table(spark, d, "benchmark"), new_path(spark, "lines")
    line = F.concat(F.lit("http://h/"), "item_id", F.lit(",T"), "item_id", F.lit(",a,"), F.left(F.regexp_replace("text", r"[\s,]+", " "), F.lit(20)), F.lit(",b"))
    b.select(line.alias("value")).write.text(path)
    return readers.crawl_csv(spark, path, ["url", "title", "text"])


@query("""SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark WHERE trim(text) <> ''""")
def question_files(spark, d) -> DataFrame:
    """Questions as lines of a file, numbered by place."""
    b, path = table(spark, d, "benchmark"), new_path(spark, "questions")
    b.coalesce(1).sortWithinPartitions("item_id").select(F.concat(F.lit(" "), F.regexp_replace("text", r"\s+", " "), F.lit("\n")).alias("value")).write.text(path)
    return readers.lines(spark, path)


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE lang END AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def merged_versions(spark, d) -> DataFrame:
    """Three versions of a keyed table, each an upsert into the one before."""
    path, at = new_path(spark, "merged"), table(spark, d, "labels")
    writers.merge(spark, table(spark, d, "documents").select("doc_id", F.col("lang").alias("state")), path, ["doc_id"], 0)
    writers.merge(spark, at.select("doc_id", F.lit("bad").alias("state")), path, ["doc_id"], 1)
    return writers.merge(spark, at.filter("quality = 1").select("doc_id", F.lit("good").alias("state")), path, ["doc_id"], 2)


@query("""SELECT vec_id::VARCHAR AS id, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings""")
def merged_vectors(spark, d) -> DataFrame:
    """Points written anew by id into a collection of their dimension."""
    path = new_path(spark, "points")
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    writers.merge_vectors(spark, e, path, 64, 0)
    turned = e.filter("cast(id as long) % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    return writers.merge_vectors(spark, turned, path, 64, 1).select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("""SELECT conv_id, turn, left(replace(text, chr(10), ' '), 200) AS text, count(*) AS n FROM (SELECT * FROM conversations UNION ALL SELECT * FROM conversations WHERE role = 'user') GROUP BY ALL""")
def appended_logs(spark, d) -> DataFrame:
    """A log that two runs append to."""
    c, path = table(spark, d, "conversations"), new_path(spark, "log")
    writers.append(writers.log_rows(c), path)
    writers.append(writers.log_rows(c.filter("role = 'user'")), path)
    return spark.read.parquet(path).groupBy("conv_id", "turn", "text").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1""")
def refreshed_tables(spark, d) -> DataFrame:
    """A table that is written anew as a whole."""
    e, path = table(spark, d, "events").select("event_id", "event_type"), new_path(spark, "fresh")
    writers.refresh(e, path)
    writers.refresh(e.filter("event_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256(text) AS sha, length(text)::BIGINT AS n FROM documents""")
def decoded_files(spark, d) -> DataFrame:
    """Texts out of bytes of an encoding that is not told."""
    t = table(spark, d, "documents").select("doc_id", documents.decoded(F.encode("text", "UTF-8")).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("sha"), F.length("t").cast("long").alias("n"))
