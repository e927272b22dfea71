"""The engine's own queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import models, urls
from lectern.functions import text as tx
from lectern.functions.vectors import l2_normalize
from lectern.operators import answers, chunking, containment, evaluation, intents, pages, retrieval, tables
from lectern.plans import QUERIES, SQL, files, judged, office_files, page_parts, records, repairs, runs, search, wrapped, wrapped_records
from lectern.plans import query as _query
from lectern.sources.readers import table
from lectern.sources.shared import shared_dir
from lectern.sources.writers import log_rows
from lectern.streaming import incremental

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "files", "judged", "office_files", "page_parts", "records", "repairs", "runs", "search", "wrapped", "wrapped_records"]

# pages ----------------------------------------------------------------------------------------------------------------

_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<nav\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer>', ' ', 'g'),
 '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""
_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
_PAIRS = r"list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'article.offset=')))"
_CANON = rf"regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string({_PAIRS}, '&') ELSE '' END"
_HOST = r"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PARTS = r"list_filter(string_split(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')"
_QUERY = r"regexp_extract({u}, '\?([^#]*)', 1)"
_PARAM = r"regexp_extract({u}, '[?&]{n}=([^&#]*)', 1)"
_PAGES = f"""p AS (SELECT page_id, url, {_CANON} AS canonical_url, {_TEXT} AS text, {_TITLE} AS title FROM pages)"""
_BASE = f"string_split({_HOST.format(u='canonical_url')}, '.')[1] || '_' || CASE WHEN len({_PARTS.format(u='canonical_url')}) > 0 THEN regexp_replace({_PARTS.format(u='canonical_url')}[-1], '\\.[A-Za-z]+$', '') ELSE 'index' END"
_P = lambda n: _PARAM.format(u="canonical_url", n=n)


@_query(f"""WITH {_PAGES} SELECT page_id, canonical_url, {_HOST.format(u="url")} AS site, array_to_string({_PARTS.format(u="url")}[1:2], '/') AS section, title, length(text)::INT AS text_length,
 CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang, sha256(text) AS page_sha256,
 {_BASE} || CASE WHEN {_P("articleNo")} <> '' THEN '_' || {_P("articleNo")} WHEN {_P("article[.]offset")} <> '' THEN '_' || {_P("article[.]offset")} WHEN {_P("page")} <> '' THEN '_p' || {_P("page")}
   WHEN {_QUERY.format(u="canonical_url")} <> '' THEN '_' || left(md5({_QUERY.format(u="canonical_url")}), 8) ELSE '' END AS doc_key,
 regexp_replace(md5(canonical_url), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM p""")
def page_unify(spark, d) -> DataFrame:
    """Raw pages to unified documents: keys, fields, digests."""
    return pages.unify(table(spark, d, "pages")).select("page_id", "canonical_url", "site", "section", "title", "text_length", "lang", "page_sha256", "doc_key", "point_id")


_BAD = ", ".join(f"'{e.lower()}'" for e in pages.ERRORS)


@_query(f"""WITH {_PAGES} SELECT CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 500000 THEN 'too_long' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 20 THEN 'few_words'
 WHEN len(list_filter([{_BAD}], lambda e: contains(lower(text), e))) > 0 THEN 'error_page' WHEN length(title) < 2 THEN 'no_title' WHEN length(translate(text, ' ' || chr(10), '')) < 50 THEN 'white_space' ELSE 'OK' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def page_quality_reasons(spark, d) -> DataFrame:
    """Pages by the first quality test that they fail."""
    u = pages.unify(table(spark, d, "pages"))
    return u.groupBy(pages.quality_reason(F.col("text"), F.col("title")).alias("reason")).agg(F.count("*").alias("n"))


@_query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT CASE WHEN regexp_matches(href, '(?i)^(mailto|javascript|tel):|^#|^$') THEN 'skip' WHEN lower(regexp_extract(href, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) IN ('pdf','hwp','hwpx','doc','docx','xls','xlsx') OR regexp_matches(lower(href), 'download|mode=download|filedown|attach') THEN 'attachment' ELSE 'page' END AS kind,
 count(*) AS n, count(DISTINCT href) AS hrefs, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""")
def page_links(spark, d) -> DataFrame:
    """Anchors of all pages by kind."""
    return pages.links(table(spark, d, "pages")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("href").alias("hrefs"), F.countDistinct("page_id").alias("pages"))


@_query(rf"""SELECT page_id, {_HOST.format(u="url")} AS host, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(x) > 0 THEN '?' || array_to_string(x, '&') ELSE '' END AS cleaned, left(sha1(url), 16) AS cache_key, md5(url || '::' || left(html, 100)) AS point_key, {_PARAM.format(u="url", n="page")} AS page_param,
 regexp_matches(url, '(?i)^https?://') AND NOT regexp_matches(url, '(?i)[.](jpg|png|zip)$') AS allowed
FROM (SELECT *, list_filter(string_split({_QUERY.format(u="url")}, '&'), lambda p: regexp_matches(p, '=.') AND NOT regexp_matches(p, '^article([.]offset|Limit)=')) AS x FROM pages)""")
def url_functions(spark, d) -> DataFrame:
    """Host, cleaned address, keys, parameters and the allow rule of each page's address."""
    df = table(spark, d, "pages")
    ok = pages.allowed(F.col("url"), None, [], [r"[.](jpg|png|zip)$"]) & F.col("url").rlike("(?i)^https?://")
    return df.select("page_id", urls.host("url").alias("host"), urls.clean("url").alias("cleaned"), F.left(F.sha1("url"), F.lit(16)).alias("cache_key"), urls.point_id("url", "html").alias("point_key"), urls.param("url", "page").alias("page_param"), ok.alias("allowed"))


@_query(rf"""SELECT {_HOST.format(u="url")} AS site, count(*) AS pages, count(DISTINCT {_CANON}) AS canonical, max(page_id) AS newest, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1""")
def crawl_index(spark, d) -> DataFrame:
    """The crawl index as a view over pages."""
    df = table(spark, d, "pages")
    return df.groupBy(urls.host("url").alias("site")).agg(F.count("*").alias("pages"), F.countDistinct(urls.normalize("url")).alias("canonical"), F.max("page_id").alias("newest"), F.sum(F.length("html")).alias("chars"))


@_query(rf"""WITH l AS (SELECT {_HOST.format(u="url")} AS src, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS dst FROM pages),
s AS (SELECT DISTINCT src AS node, 0 AS depth FROM l) SELECT * FROM s UNION ALL SELECT DISTINCT dst, 1 FROM l WHERE dst NOT IN (SELECT node FROM s)""")
def crawl_frontier(spark, d) -> DataFrame:
    """Breadth-first from the hosts over their links, each node at its smallest depth."""
    p = table(spark, d, "pages")
    edges = pages.links(p.select("url", "html"), "url").select(urls.host("url").alias("src"), F.col("href").alias("dst"))
    shared_dir(spark)
    return pages.frontier(edges, edges.select(F.col("src").alias("node")), 2)


@_query(rf"""SELECT url FROM (SELECT DISTINCT {_CANON} AS url FROM pages) WHERE url NOT IN (SELECT {_CANON} FROM pages WHERE contains(url, 'ref='))""")
def crawl_queue_cleanup(spark, d) -> DataFrame:
    """Canonical addresses without those that were fetched with a referrer."""
    p = table(spark, d, "pages")
    return pages.clean_queue(p, p.filter(F.contains("url", F.lit("ref="))))


# texts ----------------------------------------------------------------------------------------------------------------


@_query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)top\s*↑|Home\s*›|sitemap', ' ', 'g'), '(?i)copyright.*?all\s+rights\s+reserved', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned,
 length(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '' AND NOT regexp_matches(trim(regexp_replace(s, '\s+', ' ', 'g')), '(?i)^(Copyright|All Rights Reserved|\d+$|-\s*\d+\s*-$)')), chr(10)), '\s+', ' ', 'g')))::INT AS lines_length,
 len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::INT AS emails, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[이메일 확인: 원문 참조]', 'g')) AS redacted,
 CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS guessed FROM documents""")
def text_cleaners(spark, d) -> DataFrame:
    """Cleaned, line-filtered and redacted texts (digests), and the guessed language."""
    df = table(spark, d, "documents")
    return df.select("doc_id", F.md5(tx.clean_corpus("text")).alias("cleaned"), F.length(tx.clean_lines("text")).alias("lines_length"), F.size(F.regexp_extract_all("text", F.lit(tx.EMAIL), 0)).alias("emails"), F.md5(tx.redact_emails("text")).alias("redacted"), tx.guess_lang("text").alias("guessed"))


_TOK = r"list_filter(regexp_split_to_array(lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g')), '\s+'), lambda w: w <> '')"
_GRAMS = "list_concat({k}, list_concat(flatten(list_transform(list_filter({k}, lambda w: length(w) >= 2), lambda w: list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))), flatten(list_transform(list_filter({k}, lambda w: length(w) >= 3), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))))"


@_query(f"""WITH t AS (SELECT doc_id, {_TOK.format(t="text")} AS k FROM documents) SELECT doc_id, len(k)::INT AS words, len({_GRAMS.format(k="k")})::INT AS terms, len(list_distinct({_GRAMS.format(k="k")}))::INT AS distinct_terms FROM t""")
def token_counts(spark, d) -> DataFrame:
    """Words, and words with their character n-grams, per document."""
    return retrieval.term_counts(table(spark, d, "documents"))


@_query("""SELECT source, lang, count(*) AS n, sum(length(text))::BIGINT AS chars, avg(length(text)) AS mean_chars, max(length(text)) AS longest, count(DISTINCT text) AS texts FROM documents GROUP BY ALL""")
def corpus_stats(spark, d) -> DataFrame:
    """Counts and lengths by source and language."""
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.avg(n).alias("mean_chars"), F.max(n).cast("long").alias("longest"), F.countDistinct("text").alias("texts"))


@_query("""SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents WHERE trim(text) <> '' GROUP BY text""")
def dedupe_keep_first(spark, d) -> DataFrame:
    """The first document of each text, and how many there are."""
    df = table(spark, d, "documents").filter(F.btrim("text") != "").withColumn("copies", F.lit(1))
    first = tables.keep_first(df.select("text", "doc_id", "source"), ["text"], ["doc_id"])
    return first.join(df.groupBy("text").agg(F.count("*").alias("copies")), "text").select("doc_id", "source", "copies")


_UNION = """SELECT text, 'doc' AS source_type, doc_id::VARCHAR AS document_name, 1 AS o FROM documents UNION ALL SELECT text, 'benchmark', item_id::VARCHAR, 2 FROM benchmark UNION ALL SELECT text, 'chat', conv_id || '_' || turn, 3 FROM conversations"""


@_query(f"""SELECT source_type, count(*) AS n, sum(length(text))::BIGINT AS chars, min(document_name) AS first_name FROM (SELECT text, arg_min(source_type, {{'o': o, 'n': document_name}}) AS source_type, arg_min(document_name, {{'o': o, 'n': document_name}}) AS document_name FROM ({_UNION}) WHERE trim(text) <> '' GROUP BY text) GROUP BY 1""")
def corpus_merge(spark, d) -> DataFrame:
    """Three corpora aligned by name, united, the first of each text kept."""
    docs = table(spark, d, "documents").select("text", F.lit("doc").alias("source_type"), F.col("doc_id").cast("string").alias("document_name"), F.lit(1).alias("o"))
    bench = table(spark, d, "benchmark").select("text", F.lit("benchmark").alias("source_type"), F.col("item_id").cast("string").alias("document_name"), F.lit(2).alias("o"))
    chat = table(spark, d, "conversations").select("text", F.lit("chat").alias("source_type"), F.concat_ws("_", "conv_id", "turn").alias("document_name"), F.lit(3).alias("o"))
    one = tables.keep_first(docs.unionByName(bench).unionByName(chat).filter(F.btrim("text") != ""), ["text"], ["o", "document_name"])
    return one.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("document_name").alias("first_name"))


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_FIRST = "least(" + ", ".join(f"nullif(instr({{x}}, '{c}'), 0)" for c in ".!?。") + "{more})"
_CHUNKS = """SELECT doc_id || '__' || (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1) AS chunk_id, doc_id, source, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks, part AS text, a::INT AS start, z::INT AS "end" """


@_query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, source, t, n, 0 AS a, CASE WHEN n <= 1000 THEN n ELSE {{end0}} END AS z FROM d UNION ALL SELECT doc_id, source, t, n, z - 150, {{end1}} FROM w WHERE n > 1000 AND z - 150 > 0 AND z - 150 < n),
p AS (SELECT *, {_STRIP.format(x="substr(t, a + 1, z - a)")} AS part FROM w) {_CHUNKS.replace("z::INT", "least(z, n)::INT")} FROM p WHERE part <> ''""".replace("{end0}", "CASE WHEN 1000 < n AND 1000 - coalesce({p}, 1001) > 500 THEN 1001 - {p} ELSE 1000 END".replace("{p}", _FIRST.format(x="reverse(substr(t, 1, 1000))", more=""))).replace("{end1}", "CASE WHEN z + 850 < n AND 1000 - coalesce({p}, 1001) > 500 THEN z - 150 + 1001 - {p} ELSE z + 850 END".replace("{p}", _FIRST.format(x="reverse(substr(t, z - 149, 1000))", more=""))))
def chunk_windows(spark, d) -> DataFrame:
    """Windows of 1000 characters snapped to sentences."""
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "source", "text"))


@_query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, source, t, n, 0 AS a, {{end0}} AS z FROM d WHERE n > 0 UNION ALL SELECT doc_id, source, t, n, s, {{end1}} FROM (SELECT *, CASE WHEN z - a < 100 THEN z ELSE greatest(0, z - 100) END AS s FROM w) WHERE z < n)
SELECT * FROM ({_CHUNKS} FROM (SELECT *, substr(t, a + 1, z - a) AS part FROM w) WHERE z - a >= 100 OR (z >= n AND z - a >= 40))""".replace("{end0}", "least(n, 800) + coalesce({p}, 0)".replace("{p}", _FIRST.format(x="substr(t, least(n, 800) + 1, 200)", more=", nullif(instr(substr(t, least(n, 800) + 1, 200), chr(10)), 0)"))).replace("{end1}", "least(n, s + 800) + coalesce({p}, 0)".replace("{p}", _FIRST.format(x="substr(t, least(n, s + 800) + 1, 200)", more=", nullif(instr(substr(t, least(n, s + 800) + 1, 200), chr(10)), 0)"))))
def chunk_stretched(spark, d) -> DataFrame:
    """Windows of 800 characters stretched to the next sentence's end."""
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "source", "text"), kind="stretched")


@_query()
def chunk_recursive(spark, d) -> DataFrame:
    """Recursive splitting into pieces of 1000 characters."""
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "source", "text"), kind="recursive")


# keyed tables and increments --------------------------------------------------------------------------------------------


@_query("""WITH c AS (SELECT conv_id || '__' || turn AS chunk_id, role, md5(text) AS h FROM conversations), g AS (SELECT chunk_id, CASE WHEN role = 'system' THEN 'old' ELSE h END AS h FROM c WHERE role <> 'assistant')
SELECT c.chunk_id, c.h AS content_hash FROM c LEFT JOIN g ON g.chunk_id = c.chunk_id AND g.h = c.h WHERE g.chunk_id IS NULL""")
def changed_chunks(spark, d) -> DataFrame:
    """Chunks to embed again: those without a log entry (assistant) or with another content (system)."""
    c = table(spark, d, "conversations").select(F.concat_ws("__", "conv_id", "turn").alias("chunk_id"), "role", "text")
    log = c.filter("role <> 'assistant'").select("chunk_id", F.lit("old").alias("content_hash"), F.lit(0).alias("seq"))
    log = log.unionByName(c.filter("role = 'user'").select("chunk_id", F.md5("text").alias("content_hash"), F.lit(1).alias("seq")))
    return tables.changed(c, log).select("chunk_id", "content_hash")


@_query("""SELECT conv_id || '__' || turn AS chunk_id FROM conversations WHERE role = 'system'""")
def stale_chunks(spark, d) -> DataFrame:
    """Logged chunks that are no longer there."""
    c = table(spark, d, "conversations").select(F.concat_ws("__", "conv_id", "turn").alias("chunk_id"), "role")
    return tables.stale(c, c.filter("role <> 'system'"))


@_query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def latest_per_key(spark, d) -> DataFrame:
    """The last event of each user."""
    return tables.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@_query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'judged' END AS lang FROM documents LEFT JOIN labels l USING (doc_id) UNION ALL SELECT -1 - item_id, 'item' FROM benchmark""")
def upsert_rows(spark, d) -> DataFrame:
    """Documents with judged ones replaced and benchmark items added."""
    old = table(spark, d, "documents").select("doc_id", "lang")
    new = table(spark, d, "labels").select("doc_id", F.lit("judged").alias("lang")).unionByName(table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("item").alias("lang")))
    return tables.upsert(old, new, ["doc_id"])


@_query("""WITH n AS (SELECT 'f' || doc_id || '.txt' AS name, sha256(text) AS sha, doc_id FROM documents), c AS (SELECT name, CASE WHEN quality = 1 THEN sha ELSE 'other' END AS old FROM n JOIN labels USING (doc_id))
SELECT n.name, n.sha, CASE WHEN old IS NULL OR old = sha THEN n.name ELSE replace(n.name, '.txt', '_' || left(sha, 8) || '.txt') END AS object, CASE WHEN old IS NULL THEN 'put' WHEN old = sha THEN 'skip' ELSE 'rename' END AS action FROM n LEFT JOIN c ON c.name = n.name""")
def blob_puts(spark, d) -> DataFrame:
    """Objects to store: equal content is skipped, another content under a taken name is renamed."""
    n = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("name"), F.sha2("text", 256).alias("sha"))
    c = n.join(table(spark, d, "labels"), "doc_id").select("name", F.when(F.col("quality") == 1, F.col("sha")).otherwise("other").alias("sha"))
    return tables.put_blobs(n.drop("doc_id"), c)


@_query("""WITH e AS (SELECT user_id, event_id, event_type <> 'purchase' AS seen, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
n AS (SELECT *, sum(seen::INT) OVER (PARTITION BY user_id, g ORDER BY event_id) AS n FROM e), s AS (SELECT *, max((n >= 5)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM n) SELECT user_id, event_id FROM s WHERE stop = 0""")
def early_stop(spark, d) -> DataFrame:
    """Each user's events before the first run of five that are no purchase."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "purchase").alias("seen"))
    return tables.early_stop(e, "user_id", "event_id", "seen").select("user_id", "event_id")


@_query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM events""")
def forward_fill(spark, d) -> DataFrame:
    """The last click's value at each event of a user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("value")), True).over(w).alias("filled"))


@_query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, min(event_id) AS first_id, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users FROM events GROUP BY ALL""")
def day_pivot(spark, d) -> DataFrame:
    """Day by type, with the items of each cell in order."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return e.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.array_join(F.sort_array(F.collect_set(F.col("user_id").cast("string"))), ",").alias("users"))


@_query("""SELECT conv_id, turn, role, left(replace(text, chr(10), ' '), 200) AS text FROM conversations""")
def interaction_log(spark, d) -> DataFrame:
    """Rows of the interaction log."""
    return log_rows(table(spark, d, "conversations"))


@_query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate::DATE >= DATE '1996-06-01' AS recent FROM orders""")
def dates_and_recency(spark, d) -> DataFrame:
    """The first valid date of several spellings, and the recency test."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy.M.d").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("b"))
    return o.select("o_orderkey", F.date_format(urls.best_date(F.lit("no date"), "a", "b"), "yyyy-MM-dd").alias("day"), pages.recent(F.col("b"), "1996-06-01").alias("recent"))


@_query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark, d) -> DataFrame:
    """Counts by day and type, by a streaming query over all files."""
    out = incremental.run_to_end(incremental.windowed_counts(incremental.stream(spark, d, "events"), "ts", "event_type"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("""SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1""")
def stream_first_seen(spark, d) -> DataFrame:
    """Keys seen by a streaming query, each once."""
    seen = incremental.run_to_end(incremental.first_seen(incremental.stream(spark, d, "events").select("user_id"), "user_id"), "append")
    return seen.groupBy("user_id").agg(F.count("*").alias("n"))


# intents --------------------------------------------------------------------------------------------------------------

_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(trim(text), '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in intents.INTENTS) + " ELSE 'general' END"


@_query(f"""SELECT {_INTENT} AS intent, role, count(*) AS n FROM conversations GROUP BY ALL""")
def intent_counts(spark, d) -> DataFrame:
    """Messages by intent."""
    return table(spark, d, "conversations").groupBy(intents.classify(F.col("text")).alias("intent"), "role").agg(F.count("*").alias("n"))


_KW = "CASE " + " ".join(f"WHEN intent = '{k}' THEN '{v}'" for k, v in intents.KEYWORDS.items()) + " ELSE left(text, 10) END"


@_query(f"""SELECT conv_id, turn, intent, {_KW} AS keyword, NULL::VARCHAR AS alert, false AS refuses FROM (SELECT *, {_INTENT} AS intent FROM conversations WHERE role = 'user')""")
def response_keywords(spark, d) -> DataFrame:
    """Intent, shown keyword, alert category and refusal flag of each user message."""
    q = table(spark, d, "conversations").filter("role = 'user'").withColumn("intent", intents.classify(F.col("text")))
    return q.select("conv_id", "turn", "intent", intents.shown_keyword(F.col("text"), F.col("intent")).alias("keyword"), intents.alert(F.col("text")).alias("alert"), intents.refuses(F.col("text")).alias("refuses"))


# retrieval ------------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _questions(spark, d) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return _vectors(spark, d).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector", "label")


_COS = "list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE)) * list_dot_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)))"
_DENSE = f"""s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@_query(f"""WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM dense WHERE rank <= 5""")
def dense_top_k(spark, d) -> DataFrame:
    """The five nearest vectors of each query."""
    return retrieval.dense(_questions(spark, d), _vectors(spark, d), 5).withColumn("score", F.round("score", 6))


@_query(f"""WITH {_DENSE}, h AS (SELECT * FROM dense WHERE rank BETWEEN 2 AND 6) SELECT query_id, doc_id, rank::INT AS rank FROM h WHERE (SELECT max(score) FROM h x WHERE x.query_id = h.query_id) >= 0.4""")
def dense_threshold(spark, d) -> DataFrame:
    """Hits but the query itself, none at all where the best is below 0.4."""
    hits = retrieval.dense(_questions(spark, d), _vectors(spark, d), 6).filter("rank > 1")
    return retrieval.drop_below(hits).select("query_id", "doc_id", "rank")


@_query(f"""WITH {_DENSE}, b AS (SELECT dense.*, score + CASE WHEN e.label = 3 THEN 0.1 ELSE 0 END AS boosted FROM dense JOIN embeddings e ON e.vec_id = doc_id WHERE rank <= 15),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS r FROM b) SELECT query_id, doc_id, round(score, 6) AS score, round(boosted, 6) AS boosted, r::INT AS rank FROM r WHERE r <= 5""")
def boosted_search(spark, d) -> DataFrame:
    """Three times as many hits as asked for, boosted by a rule, the five best kept with their plain scores."""
    hits = retrieval.dense(_questions(spark, d), _vectors(spark, d), 15).join(_vectors(spark, d).select("doc_id", F.concat(F.lit("board-"), "label").alias("board_name")), "doc_id")
    rules = [("event", [("board_name", "board-3")], 0.1)]
    out = intents.rerank_with_boost(hits.withColumn("intent", F.lit("event")), 5, rules)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("boosted", 6).alias("boosted"), "rank")


_BM25_COUNTS = f"""dt AS (SELECT doc_id, {_GRAMS.format(k="k")} AS t FROM (SELECT doc_id, {_TOK.format(t="text")} AS k FROM documents)), qt AS (SELECT item_id AS query_id, unnest({_GRAMS.format(k="k")}) AS term FROM (SELECT item_id, {_TOK.format(t="text")} AS k FROM benchmark)),
c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY doc_id, term)"""
_OKAPI_IDF = "raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, c GROUP BY term), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"
_BM25_SCORES = """q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), c GROUP BY ALL)"""
_BM25 = f"{_BM25_COUNTS}, {_OKAPI_IDF}, {_BM25_SCORES}"
_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, doc_id)"


def _items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@_query(f"""WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM (SELECT query_id, doc_id, score, {_RANKED.format(s="round(score, 4)")} AS rank FROM bm) WHERE rank <= 5""")
def bm25_top_k(spark, d) -> DataFrame:
    """Okapi BM25 over words and character n-grams."""
    return retrieval.bm25(_items(spark, d), _documents(spark, d), 5, digits=4)


_SPARSE_IDF = "idf AS (SELECT term, power(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 2) AS idf FROM tf, c GROUP BY term)"
_SPARSE = f"{_BM25_COUNTS}, {_SPARSE_IDF}, {_BM25_SCORES}"


@_query(f"""WITH {_SPARSE} SELECT query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM (SELECT query_id, doc_id, score, {_RANKED.format(s="round(score, 4)")} AS rank FROM bm) WHERE rank <= 5""")
def sparse_top_k(spark, d) -> DataFrame:
    """The product of sparse vectors, both of which carry an idf that is never negative."""
    return retrieval.bm25(_items(spark, d), _documents(spark, d), 5, idf=retrieval.sparse_idf, digits=4)


_HYBRID = f"""{_BM25}, mm AS (SELECT query_id, CASE WHEN count(*) < any_value(n) THEN least(min(score), 0) ELSE min(score) END AS lo, max(score) AS hi FROM bm, c GROUP BY query_id), nb AS (SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE score / greatest(hi, 1) END, 7) AS b FROM bm JOIN mm USING (query_id)),
sp AS (SELECT * FROM (SELECT *, {_RANKED.format(s="b")} AS rank FROM nb) WHERE rank <= 25), ds AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)), de AS (SELECT * FROM (SELECT *, {_RANKED.format(s="s")} AS rank FROM ds) WHERE rank <= 25)"""


def _both(spark, d):
    sparse = retrieval.bm25(_items(spark, d), _documents(spark, d), 25, normalised=True, digits=7)
    asked = _vectors(spark, d).select(F.col("doc_id").alias("query_id"), "vector").join(_items(spark, d).select("query_id"), "query_id", "left_semi")
    return retrieval.dense(asked, _vectors(spark, d), 25), sparse


@_query(f"""WITH {_HYBRID}, f AS (SELECT query_id, doc_id, round(0.85 * coalesce(s, 0) + 0.15 * coalesce(b, 0), 6) AS score FROM de FULL JOIN sp USING (query_id, doc_id)), t AS (SELECT *, {_RANKED.format(s="score")} AS former FROM f),
o AS (SELECT t.*, round(score + CASE WHEN label = 3 THEN 0.1 ELSE 0 END, 6) AS boosted FROM t LEFT JOIN embeddings ON vec_id = doc_id WHERE former <= 15)
SELECT query_id, doc_id, score, boosted, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, former) AS rank FROM o) WHERE rank <= 5""")
def hybrid_search(spark, d) -> DataFrame:
    """Dense and min-max normalised BM25, five times as many hits as asked for, fused with weight 0.85; of three times as many
    the five best with a rule's bonus, with their plain scores."""
    dense, sparse = _both(spark, d)
    hits = retrieval.fuse(dense, sparse, 0.85, 25).withColumn("score", F.round("score", 6)).drop("rank")
    hits = retrieval.top_k(hits, 15).join(_vectors(spark, d).select("doc_id", F.concat(F.lit("board-"), "label").alias("board_name")), "doc_id", "left")
    out = intents.rerank_with_boost(hits.withColumn("intent", F.lit("event")), 5, [("event", [("board_name", "board-3")], 0.1)], digits=6)
    return out.select("query_id", "doc_id", "score", "boosted", "rank")


@_query(f"""WITH {_HYBRID}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM de WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, rank FROM sp WHERE rank <= 15) GROUP BY ALL) SELECT query_id, doc_id, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, {_RANKED.format(s="score")} AS rank FROM f) WHERE rank <= 5""")
def rrf_search(spark, d) -> DataFrame:
    """Reciprocal rank fusion of both lists."""
    dense, sparse = _both(spark, d)
    hits = retrieval.reciprocal_rank_fusion([dense.filter("rank <= 15"), sparse.filter("rank <= 15")], 30).withColumn("score", F.round("score", 9)).drop("rank")
    return retrieval.top_k(hits, 5)


@_query(f"""WITH {_HYBRID.replace("rank <= 25", "rank <= 50")}, f AS (SELECT query_id, doc_id, 0.85 * coalesce(s, 0) + 0.15 * coalesce(b, 0) AS score FROM de FULL JOIN sp USING (query_id, doc_id)), c AS (SELECT * FROM (SELECT *, {_RANKED.format(s="score")} AS former FROM f) WHERE former <= 30),
m AS (SELECT query_id, c.doc_id, ((length(left(d.text, 512)) * 31 + length(b.text) * 17 + ascii(d.text) * 7919) % 1000)::DOUBLE AS score FROM c JOIN documents d ON d.doc_id = c.doc_id JOIN benchmark b ON b.item_id = c.query_id)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, {_RANKED.format(s="score")} AS rank FROM m) WHERE rank <= 5""".replace("c AS (SELECT count(*) AS n", "c0 AS (SELECT count(*) AS n").replace("FROM tf, c GROUP", "FROM tf, c0 GROUP").replace("JOIN tf USING (term), c GROUP", "JOIN tf USING (term), c0 GROUP").replace("FROM bm, c GROUP", "FROM bm, c0 GROUP"))
def reranked_search(spark, d) -> DataFrame:
    """Fifty hits of dense search and of BM25 fused, thirty scored again by a model of question and text, five kept."""
    sparse = retrieval.bm25(_items(spark, d), _documents(spark, d), 50, normalised=True, digits=7)
    asked = _vectors(spark, d).select(F.col("doc_id").alias("query_id"), "vector").join(_items(spark, d).select("query_id"), "query_id", "left_semi")
    dense = retrieval.dense(asked, _vectors(spark, d), 50)
    pairs = dense.select("query_id", "doc_id").unionByName(sparse.select("query_id", "doc_id")).distinct()
    texts = pairs.join(_documents(spark, d), "doc_id").join(_items(spark, d).withColumnRenamed("text", "query"), "query_id")
    model = lambda q, t: ((F.length(t) * 31 + F.length(q) * 17 + F.ascii(t) * 7919) % 1000).cast("double")
    return answers.reranked_search(dense, sparse, texts, model, chars=512).select("query_id", "doc_id", "score", "rank")


_REL = "t AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _truth(spark, d) -> DataFrame:
    """Documents that hold an item's text: one automaton of all items, documents read once."""
    return containment.holding(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("name")))


@_query(f"""WITH {_BM25}, {_REL}, h AS (SELECT * FROM (SELECT query_id, doc_id, {_RANKED.format(s="round(score, 4)")} AS rank FROM bm) WHERE rank <= 5), f AS (SELECT t.query_id, min(rank) AS f FROM t LEFT JOIN h ON h.query_id = t.query_id AND h.doc_id = t.doc_id GROUP BY 1)
SELECT count(*) AS queries, avg((coalesce(f, 99) <= 1)::INT) AS recall_1, avg((coalesce(f, 99) <= 3)::INT) AS recall_3, avg((coalesce(f, 99) <= 5)::INT) AS recall_5, round(avg(coalesce(1.0 / f, 0)), 9) AS mrr FROM f""")
def recall_and_mrr(spark, d) -> DataFrame:
    """Recall at 1, 3 and 5 and MRR of BM25 against containment."""
    return evaluation.recall_and_mrr(bm25_top_k(spark, d), _truth(spark, d)).withColumn("mrr", F.round("mrr", 9))


@_query(f"""WITH {_BM25}, {_REL}, h AS (SELECT * FROM (SELECT query_id, doc_id, {_RANKED.format(s="round(score, 4)")} AS rank FROM bm) WHERE rank <= 5), g AS (SELECT t.query_id, count(*) AS n, coalesce(sum(1.0 / log2(h.rank + 1)), 0) AS dcg FROM t LEFT JOIN h ON h.query_id = t.query_id AND h.doc_id = t.doc_id GROUP BY 1)
SELECT query_id, round(dcg, 6) AS dcg, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0 / log2(i + 1))), 6) AS ndcg FROM g""")
def ndcg_at_5(spark, d) -> DataFrame:
    """DCG with an ideal of 1, and true NDCG, per query."""
    return evaluation.ndcg(bm25_top_k(spark, d), _truth(spark, d)).select("query_id", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


# evaluation -----------------------------------------------------------------------------------------------------------


@_query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY 1""")
def latency_stats(spark, d) -> DataFrame:
    """Mean, median, least and most by kind of run."""
    out = evaluation.latency(table(spark, d, "events"), "value", ["event_type"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@_query(f"""WITH {_DENSE}, t AS (SELECT score FROM dense WHERE rank = 2) SELECT count_if(score >= 0.7)::BIGINT AS high, count_if(score >= 0.6)::BIGINT AS good, count_if(score < 0.5)::BIGINT AS low, avg((score >= 0.7)::INT * 100.0) AS high_pct, avg((score >= 0.6)::INT * 100.0) AS good_pct, avg((score < 0.5)::INT * 100.0) AS low_pct FROM t""")
def score_bands(spark, d) -> DataFrame:
    """How many queries have a best hit in each band of scores."""
    return evaluation.score_bands(retrieval.dense(_questions(spark, d), _vectors(spark, d), 2).filter("rank = 2"), "score")


@_query("""WITH m AS (SELECT event_type, 'value' AS metric, avg(value) AS mean FROM events GROUP BY 1 UNION ALL SELECT event_type, 'hour', avg(hour(ts)) FROM events GROUP BY 1), s AS (SELECT metric, max(CASE WHEN event_type = 'click' THEN mean END) AS base, arg_max(event_type, {'a': mean, 'b': event_type}) AS b FROM m GROUP BY 1)
SELECT event_type, metric, round(mean, 6) AS mean, round(CASE WHEN base > 0 THEN (mean - base) / base * 100 END, 4) AS improvement, event_type = b AS best FROM m JOIN s USING (metric)""")
def compare_variants(spark, d) -> DataFrame:
    """Metric means of each variant, the gain over a baseline, and the best one."""
    e = table(spark, d, "events").select("event_type", "value", F.hour("ts").alias("hour"))
    return evaluation.compare_variants(e, "event_type", ["value", "hour"], "click").withColumn("mean", F.round("mean", 6)).withColumn("improvement", F.round("improvement", 4))


@_query("""SELECT quality, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM labels GROUP BY 1""")
def label_distribution(spark, d) -> DataFrame:
    """Counts and shares of the judged labels."""
    return evaluation.distribution(table(spark, d, "labels"), "quality")


@_query(f"""WITH v AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100), s AS (SELECT {_COS} AS s FROM v a, v b WHERE a.vec_id < b.vec_id) SELECT count(*) AS pairs, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max, round(median(s), 6) AS median FROM s""")
def embedding_pairs(spark, d) -> DataFrame:
    """Similarity of the pairs of the first hundred vectors, as the report defines it."""
    out = evaluation.pair_similarity(_vectors(spark, d))
    return out.select("pairs", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median")])


_BOX = r"('0x' || left(md5(w), 6))::BIGINT % 8"


@_query(f"""WITH w AS (SELECT doc_id, unnest({_TOK.format(t="text")}) AS w FROM documents), c AS (SELECT doc_id, {", ".join(f"sum(({_BOX} = {i})::INT)::DOUBLE AS c{i}" for i in range(8))} FROM w GROUP BY 1), n AS (SELECT *, sqrt({" + ".join(f"c{i} * c{i}" for i in range(8))}) AS norm FROM c)
SELECT doc_id, {", ".join(f"round(coalesce(c{i} / norm, 0), 6) AS v{i}" for i in range(8))} FROM documents LEFT JOIN n USING (doc_id)""")
def hashed_embeddings(spark, d) -> DataFrame:
    """Vectors of texts without a model."""
    v = table(spark, d, "documents").select("doc_id", models.hashed_embedding(F.col("text"), 8).alias("v"))
    return v.select("doc_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(8)])


@_query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm FROM embeddings""")
def normalized_vectors(spark, d) -> DataFrame:
    """Squared norms after L2 normalisation."""
    v = table(spark, d, "embeddings").select("vec_id", l2_normalize("embedding").alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


FLAGSHIP = hybrid_search
