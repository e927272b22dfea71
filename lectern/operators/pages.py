"""Raw pages to unified documents: fields, filters with reasons, routing of links, site statistics, crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import urls
from lectern.sources.shared import staged

#: Phrases of error pages, and parts of image addresses that are no pictures.
ERRORS = ("404 Not Found", "404 error", "페이지를 찾을 수 없습니다", "요청하신 페이지가 존재하지 않습니다", "접근 권한이 없습니다", "Access Denied", "로그인이 필요합니다", "세션이 만료되었습니다")
ICONS = ("/_res/ko/img/icon/", "/res/ko/img/common/", "logo", "btn", "btn-", "bg_subvisual", "wa-mark", "bubble_tail", "btn_top_go", "icon", "insta", "youtube", "blog", "facebook", "twitter", "kakao", "banner", "footer", "header", "arrow", "line", "bg_", "common")
ATTACHMENTS = ("pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx")


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, navigation, headers and footers."""
    return tx.html_to_text(F.regexp_replace(html, r"(?is)<(nav|header|footer)\b[^>]*>.*?</\1>", " "))


def title(html: Column) -> Column:
    return tx.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def unify(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One select: key, site, section, title, cleaned text and its length, language, digests."""
    body = visible_text(F.col(html))
    df = pages.select(id_col, url, urls.normalize(url).alias("canonical_url"), urls.host(url).alias("site"), urls.section(url).alias("section"), title(F.col(html)).alias("title"), body.alias("text"))
    return df.select("*", urls.doc_id("canonical_url").alias("doc_key"), F.length("text").alias("text_length"), tx.guess_lang("text").alias("lang"), F.sha2("text", 256).alias("page_sha256"), urls.uuid_of("canonical_url").alias("point_id"))


def quality_reason(text: Column, page_title: Column, least: int = 100, most: int = 500_000, words: int = 20) -> Column:
    """The first test that fails, or OK."""
    solid = F.length(F.translate(text, " \n", ""))
    bad = F.exists(F.array(*[F.lit(e.lower()) for e in ERRORS]), lambda e: F.contains(F.lower(text), e))
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (
        F.when(F.length(text) < least, "too_short").when(F.length(text) > most, "too_long").when(n < words, "few_words").when(bad, "error_page")
        .when(F.length(F.btrim(F.coalesce(page_title, F.lit("")))) < 2, "no_title").when(solid < least * 0.5, "white_space").otherwise("OK")
    )


def allowed(url: Column, domain: str | None, prefixes: list[str], deny: list[str]) -> Column:
    """Right host, a prefix of the path where any are asked for, and no denied pattern."""
    ok = F.lit(True) if domain is None else urls.host(url) == domain
    if prefixes:
        ok = ok & F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(urls.path(url), p))
    for d in deny:
        ok = ok & ~url.rlike(f"(?i){d}")
    return ok


def recent(lastmod: Column, cutoff: str) -> Column:
    """At or after the cutoff; what is null or no date stays."""
    return F.coalesce(F.try_to_date(F.left(lastmod, F.lit(10)), "yyyy-MM-dd") >= F.lit(cutoff).cast("date"), F.lit(True))


def is_login(url: Column, html: Column) -> Column:
    """By the address, or by an element whose class or id speaks of logging in."""
    return F.contains(F.lower(url), F.lit("/login")) | html.rlike(r"(?i)class=[\"'][^\"']*(login-wrapper|login_wrap)") | html.rlike(r"(?i)<(form|div)[^>]*\bid=[\"'][^\"']*login[^\"']*[\"']")


#: Endings of files in addresses and link texts.
FILE_ENDING = r"(?i)\.(hwpx|hwp|pdf|docx?|xlsx?|pptx?|zip|7z|rar|png|jpe?g)$"


def download_intent(href: Column, abs_url: Column, text: Column, class_: Column) -> Column:
    """Whether a link is to a file: by its address, its class, or an ending of its address or text."""
    return F.contains(F.lower(href), F.lit("download")) | F.contains(F.lower(abs_url), F.lit("/cms/filedownload.do")) | F.contains(F.lower(class_), F.lit("file-down-btn")) | href.rlike(FILE_ENDING) | text.rlike(FILE_ENDING)


def may_download(url: Column, policy: str, allow: list[str] = (), block: list[str] = ()) -> Column:
    """By the address's path: ``allowlist`` (an allowed prefix and no blocked one), ``blocklist`` (no blocked one), or nothing."""
    begins = lambda prefixes: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(urls.path(url), p)) if prefixes else F.lit(False)
    return {"allowlist": ~begins(block) & begins(allow), "blocklist": ~begins(block)}.get(policy, F.lit(False))


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, href, kind): anchors of the whole page, attachments told from pages to follow."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), 1)).alias("pos", "href"))
    file = F.lower(F.regexp_extract("href", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).isin(*ATTACHMENTS) | F.lower("href").rlike(r"download|mode=download|filedown|attach")
    return rows.withColumn("kind", F.when(F.col("href").rlike(r"(?i)^(mailto|javascript|tel):|^#|^$"), "skip").when(file, "attachment").otherwise("page"))


def is_icon(src: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in ICONS]), lambda x: F.contains(F.lower(src), x))


def frontier(links_: DataFrame, seeds: DataFrame, rounds: int | None = None, limit: int | None = None) -> DataFrame:
    """(node, depth): breadth-first from ``seeds`` (node) over ``links_`` (src, dst), each node at its smallest depth, until a level is
    empty, or after ``rounds`` levels, or when ``limit`` nodes are found. Each level is written down."""
    seen = staged(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    level, found = seen, seen.count() if limit else 0
    d = 0
    while (rounds is None or d < rounds) and (limit is None or found < limit):
        d += 1
        near = links_.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        level = staged(near.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "level")
        n = level.count()
        if not n:
            break
        seen, found = seen.unionByName(level), found + n
    return seen


def clean_queue(queue: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Canonical queued addresses, each once, without those that were fetched."""
    return queue.select(urls.normalize(url).alias(url)).distinct().join(done.select(urls.normalize(url).alias(url)), url, "left_anti")
