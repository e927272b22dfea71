"""Queries of operators whose shapes no given table has: pages, posts, menus and records are wrapped around each row's values by one
expression, parsed, and compared with the values themselves in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import html, pages
from lectern.operators.documents import best_address
from lectern.plans import query
from lectern.sources.readers import table

#: Values of a row of ``documents``, as both dialects of SQL say them.
VALUES = {
    "id": "cast(doc_id as string)", "m": "substr(md5(coalesce(text, '')), 1, 8)", "k": "cast(doc_id % 9 + 1 as string)", "y": "cast(2020 + doc_id % 5 as string)",
    "mm": "lpad(cast(doc_id % 12 + 1 as string), 2, '0')", "dd": "lpad(cast(doc_id % 28 + 1 as string), 2, '0')", "next": "cast(doc_id + 1 as string)", "s": "source", "l": "lang", "bs": "chr(92)",
}


def filled(template: str) -> str:
    """SQL for a template with ``{value}``s, in either dialect."""
    parts = [VALUES[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{\w+\})", template) if p]
    return f"concat({', '.join(parts)})"


def wanted(**columns: str) -> str:
    """SQL for a row of ``documents`` each: templates, or SQL after an equals sign."""
    shown = ", ".join(f"{v[1:] if v.startswith('=') else filled(v)} AS {c}" for c, v in columns.items())
    return f"SELECT doc_id, {shown} FROM documents"


def _wrapped(spark, d, template: str, *parts: str, url: str = "http://h.ac.kr/a/b.do") -> DataFrame:
    """Each row's page, in parts."""
    df = table(spark, d, "documents").select("doc_id", F.expr(filled(template)).alias("html"), F.expr(filled(url)).alias("url"))
    return df.withColumn("p", html.parts("html", "url", parts)).select("doc_id", "url", "p.*")


_SITE = (
    "<html><head><title>Home | {m}</title><script>var a='<p>no</p>';</script></head><body><div class='gnb'>Menu</div><div id='wrap'><div class='contents'><h2> T{id} </h2><p>first  {m}<!-- no --></p>"
    "<p style='display: none'>gone</p><p hidden>gone</p><div class='sns-share'>Share</div><p>Mail a{id}@c.org now</p><img src='/up/p{id}.jpg' alt='Photo {k}'><img src='/img/logo.png'></div></div><footer>Foot</footer>"
    "<a href='/files/d{id}.pdf'>Doc</a><a href='mailto:a{id}@c.org'>Mail</a></body></html>"
)


@query(wanted(text="T{id}\nfirst {m}\nMail a{id}@c.org now", title="Home | {m}", main_tag="div", links="/files/d{id}.pdf mailto:a{id}@c.org", images="/up/p{id}.jpg=Photo {k} /img/logo.png=", words="=6"))
def page_contents(spark, d) -> DataFrame:
    """Main text and metadata; elements go by kind, name or because they are hidden."""
    c = _wrapped(spark, d, _SITE, "content")
    both = lambda a, x, y: F.array_join(F.transform(a, lambda r: F.concat(r[x], F.lit("="), r[y])), " ")
    return c.select("doc_id", "content.text", "content.title", "content.main_tag", F.array_join(F.transform("content.links", lambda a: a["href"]), " ").alias("links"), both("content.images", "src", "alt").alias("images"), F.col("content.word_count").alias("words"))


_SNAPSHOT = (
    '<body><div class="gnb">Menu</div><div id="wrap"><div class="contents"><h2> T{id} </h2><p>first  {m}</p><p style="display: none">gone</p><p hidden="">gone</p><div class="sns-share">Share</div><p>Mail a{id}@c.org now</p>'
    '<img src="/up/p{id}.jpg" alt="Photo {k}"/><img src="/img/logo.png"/></div></div><a href="/files/d{id}.pdf">Doc</a><a href="mailto:a{id}@c.org">Mail</a></body>'
)


@query(wanted(title="Home | {m}", snapshot=_SNAPSHOT, text_length="=length(" + filled("Menu T{id} first {m} gone gone Share Mail a{id}@c.org now Doc Mail") + ")", summary="T{id} first {m} gone gone Share Mail [이메일 확인: 원문 참조] now", redacted="=true"))
def page_snapshots(spark, d) -> DataFrame:
    """Snapshots without what frames them, summaries without addresses of mail."""
    s = _wrapped(spark, d, _SITE, "snapshot", "summary", "redacted")
    return s.select("doc_id", "snapshot.title", F.col("snapshot.html").alias("snapshot"), "snapshot.text_length", F.col("summary.text").alias("summary"), (F.contains("redacted", F.lit('data-redacted="email"')) & ~F.contains("redacted", F.lit("@"))).alias("redacted"))


_BOARD = (
    "<div class='title-area'><h3> </h3><strong>Notice {m}</strong></div><div class='board-view-information'><dl><dt>작성자</dt><dd>{s}</dd></dl><dl><dt>조회</dt><dd>{k},{y}</dd></dl>"
    "<dl><dt>작성일</dt><dd>{y}.{mm}.{dd} 10:00</dd></dl></div><table><tr><th>Day</th><th>Bus</th></tr><tr><td>{l}</td><td>A <b>{id}</b></td></tr><tr><td> </td><td></td></tr></table>"
    "<a href='?mode=download&articleNo={id}'>plan{k}.hwp</a><a href='/cms/fileDownload.do?k=1'>no</a><a href='view.do?x={id}'>no</a><img src='img/plan{id}.png' alt=' Plan {id} '><img src='/common/icon.gif'>"
)


@query(wanted(title="Notice {m}", author="{s}", views="=(1 + doc_id % 9) * 10000 + 2020 + doc_id % 5", created_at="{y}-{mm}-{dd}", any_date="{y}-{mm}-{dd}", area="Notice {m}").replace("(1 + doc_id % 9) * 10000", "cast(1 + doc_id % 9 as int) * 10000"))
def board_posts(spark, d) -> DataFrame:
    """Title, author, views and date of posts, by the board's head."""
    b = _wrapped(spark, d, _BOARD, "board", "summary")
    return b.select("doc_id", "board.title", "board.author", F.col("board.view_count").cast("long").alias("views"), "board.created_at", "board.any_date", F.col("summary.title_area").alias("area"))


_LABELS = "<ul><li><span>작성자</span><em>{s}</em></li><li><span>조회</span><em>{id}</em></li><li><span>작성일</span><em>{y}.{mm}.{dd}</em></li></ul><p class='post-date'>{y}-{mm}-{dd}</p>"


@query(wanted(label_author="{s}", label_views="=cast(doc_id as int)", label_date="{y}-{mm}-{dd}", any_date="{y}-{mm}-{dd}"))
def labelled_posts(spark, d) -> DataFrame:
    """Author, views and date of posts whose head is a list of labels."""
    b = _wrapped(spark, d, _LABELS, "board")
    return b.select("doc_id", "board.label_author", F.col("board.label_view_count").alias("label_views"), F.col("board.label_created_at").alias("label_date"), "board.any_date")


_FILE = {"link_text": "plan{k}.hwp", "download_url": "http://h.ac.kr/a/b.do?mode=download&articleNo={id}", "type": "file", "filename": "plan{k}.hwp"}
_PICTURE = {"link_text": "Plan {id}", "download_url": "http://h.ac.kr/a/img/plan{id}.png", "type": "image", "filename": "plan{id}.png"}


@query(f"{wanted(pos='=0', **_FILE)} UNION ALL {wanted(pos='=1', **_PICTURE)}")
def post_attachments(spark, d) -> DataFrame:
    """Files and pictures of posts, with the names that they would be stored under."""
    a = _wrapped(spark, d, _BOARD, "attachments").select("doc_id", F.posexplode("attachments").alias("pos", "a"))
    return a.select("doc_id", "pos", "a.link_text", "a.download_url", "a.type", "a.filename")


_ANCHORS = [
    ("?mode=download&articleNo={id}", "http://h.ac.kr/a/b.do?mode=download&articleNo={id}", "true, false, true"),
    ("/cms/fileDownload.do?k=1", "http://h.ac.kr/cms/fileDownload.do?k=1", "true, false, true"),
    ("view.do?x={id}", "http://h.ac.kr/a/view.do?x={id}", "false, false, true"),
]


@query(" UNION ALL ".join(f"SELECT doc_id, {filled(h)} AS href, {filled(u)} AS abs_url, {b.split(', ')[0]} AS download, {b.split(', ')[1]} AS allowed, {b.split(', ')[2]} AS blocked FROM documents" for h, u, b in _ANCHORS))
def page_anchors(spark, d) -> DataFrame:
    """Anchors with what they lead to, and what a policy of prefixes lets through."""
    a = _wrapped(spark, d, _BOARD, "anchors").select("doc_id", F.explode("anchors").alias("a")).select("doc_id", "a.*")
    return a.select("doc_id", "href", "abs_url", pages.download_intent(F.col("href"), F.col("abs_url"), F.col("text"), F.col("class")).alias("download"), pages.may_download(F.col("abs_url"), "allowlist", ["/files"], ["/cms"]).alias("allowed"), pages.may_download(F.col("abs_url"), "blocklist", [], ["/files"]).alias("blocked"))


@query(" UNION ALL ".join(wanted(line=x) for x in ("[표 데이터 시작]", "Day | Bus", "{l} | A{id}", "[표 데이터 끝]")))
def tables_as_text(spark, d) -> DataFrame:
    """Tables written out between marks."""
    t = _wrapped(spark, d, _BOARD, "tables").select("doc_id", F.explode(F.split("tables", "\n")).alias("line"))
    return t.filter("line not like '%<%'")


_LIST = (
    "<table><tbody><tr><td>1</td><td><a href='?mode=view&articleNo={id}'>Post  {m}</a></td><td class=date>{y}-{mm}-{dd}</td></tr><tr><td>2</td><td><a href='?mode=view&articleNo={next}'>Second</a></td><td>{y}-01-01</td></tr>"
    "<tr><th>점심</th><td>밥{k}</td><td>국</td></tr></tbody></table>"
)


@query(f"{wanted(pos='=0', url='http://h.ac.kr/list.do?mode=view&articleNo={next}')} UNION ALL {wanted(pos='=1', url='http://h.ac.kr/list.do?mode=view&articleNo={id}')}")
def article_links(spark, d) -> DataFrame:
    """Addresses of a board's articles, newest first."""
    return _wrapped(spark, d, _LIST, "article_links", url="http://h.ac.kr/list.do").select("doc_id", F.posexplode("article_links").alias("pos", "url"))


_YEAR = (
    "<div class='year-schedule'><div class='schedule-table'><table><tbody><tr><td rowspan=2>{y}년 01월</td><td>01.01(수)</td><td>신정 {m}</td></tr><tr><td>01.{dd}(금)</td><td>등록</td></tr>"
    "<tr><td>x</td></tr><tr><td>{y}년 {mm}월</td><td>{mm}.04(화)</td><td>개강 {id}</td></tr><tr><td>03.05</td><td></td></tr></tbody></table></div></div>"
)


@query(wanted(lines="{y}년 01월 | 01.01(수) | 신정 {m}\n{y}년 01월 | 01.{dd}(금) | 등록\n{y}년 {mm}월 | {mm}.04(화) | 개강 {id}"))
def year_schedules(spark, d) -> DataFrame:
    """A year's schedule as lines; rows of two cells are of the month before."""
    return _wrapped(spark, d, _YEAR, "schedule").select("doc_id", html.schedule_text(F.col("schedule")).alias("lines"))


_MENU = (
    "<table><tr><td>other</td></tr></table><table><caption>이번 주 식당 메뉴 표</caption><thead><tr><th>월 <br>3.{k}</th><th>화</th><th> </th></tr></thead><tbody><tr><td><p>중식</p><ul><li>밥 {m}</li><li>국</li></ul></td>"
    "<td><p>중식</p><ul><li>면{id}</li></ul></td></tr><tr><td><p>석식</p><ul></ul></td><td><p>석식</p><ul><li>빵</li></ul></td><td><p>x</p><ul><li>y</li></ul></td></tr><tr><td><p>중식</p><ul><li>차</li></ul></td></tr></tbody></table>"
)


@query(f"{wanted(day='월 3.{k}', meal='중식', dishes='밥 {m} / 국 / 차')} UNION ALL {wanted(day='화', meal='중식', dishes='면{id}')} UNION ALL {wanted(day='화', meal='석식', dishes='빵')}")
def menu_pivot(spark, d) -> DataFrame:
    """Dishes by day and meal."""
    m = _wrapped(spark, d, _MENU, "menu").select("doc_id", F.explode("menu").alias("m"))
    return m.select("doc_id", "m.day", "m.meal", F.array_join("m.items", " / ").alias("dishes"))


_DAYS = "<table><tr><td><span class='day'>{k}</span><ul><li>Start {m}</li><li> </li></ul></td><td>4 <ul><li>End</li></ul></td></tr></table>"
_NONE = "=cast(NULL as string)"
_LISTED = [
    {"kind": "post", "a": "Post {m}", "b": "http://h.ac.kr/list.do?mode=view&articleNo={id}", "c": "{y}-{mm}-{dd}"}, {"kind": "post", "a": "Second", "b": "http://h.ac.kr/list.do?mode=view&articleNo={next}", "c": "{y}-01-01"},
    {"kind": "dish", "a": "-", "b": "1 / Post {m} / {y}-{mm}-{dd}", "c": _NONE}, {"kind": "dish", "a": "-", "b": "2 / Second / {y}-01-01", "c": _NONE}, {"kind": "dish", "a": "점심", "b": "밥{k} / 국", "c": _NONE},
    {"kind": "row", "a": "Post {m}", "b": "{y}-{mm}-{dd}", "c": _NONE}, {"kind": "row", "a": "Second", "b": "{y}-01-01", "c": _NONE},
    {"kind": "day", "a": "{k}", "b": "Start {m}", "c": _NONE}, {"kind": "day", "a": "4 End", "b": "End", "c": _NONE},
]


@query(" UNION ALL ".join(wanted(**x) for x in _LISTED))
def list_parsers(spark, d) -> DataFrame:
    """Posts, dishes and plain rows of lists, days of calendars."""
    p, days = _wrapped(spark, d, _LIST, "lists", "rows", url="http://h.ac.kr/list.do"), _wrapped(spark, d, _DAYS, "lists")
    none = F.lit(None).cast("string")
    # all kinds of a page in one array: a union would parse it once for each
    one = lambda kind, arr, *cols: F.transform(arr, lambda x: F.struct(F.lit(kind).alias("kind"), *[(x[c] if c else none).alias(n) for c, n in zip(cols, "abc", strict=True)]))
    flat = lambda df, *arrays: df.select("doc_id", F.explode(F.concat(*arrays)).alias("x")).select("doc_id", "x.*")
    listed = flat(p, one("post", F.col("lists.posts"), "title", "url", "date"), one("dish", F.col("lists.dishes"), "key", "content", ""), one("row", F.col("rows"), "title", "date", ""))
    return listed.unionByName(flat(days, one("day", F.col("lists.dates"), "date", "title", "")))


_OLD = (
    "<head><base href='http://b/'><link rel='canonical' href=' http://c/{id} '><meta property='og:url' content='http://o/'><meta property='og:title' content='Shared {m}'></head><body><header>h</header>"
    "<div class='meta'>Fetched at: {y}-{mm}-{dd}T07:08:09</div><div class='meta'>Snapshot of <a href='http://s/'>http://s/</a></div><div role='navigation'>n</div><section>Text <b>{m}</b></section></body>"
)


@query(wanted(address="http://c/{id}", title="Shared {m}", text="Text\n{m}", selector="section", fetched="{y}-{mm}-{dd}"))
def saved_pages(spark, d) -> DataFrame:
    """Where saved pages came from, when, and their text as the older corpus took it."""
    o = _wrapped(spark, d, _OLD, "old")
    return o.select("doc_id", best_address(F.col("old")).alias("address"), "old.title", "old.text", "old.selector", "old.fetched")
