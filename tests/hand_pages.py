"""Small pages of each kind of site, with what operators should make of them by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import html, pages
from lectern.plans import rows

CASES, WANTED = {}, {}


def query(sql):
    """A case and its rows."""

    def add(f):
        CASES[f.__name__], WANTED[f.__name__] = f, sql
        return f

    return add


# small pages --------------------------------------------------------------------------------------------------------------

_SITE = (
    "<html><head><title>Home | Board</title><script>var a='<p>no</p>';</script></head><body><div class='gnb'>Menu</div><div id='wrap'><div class='contents'><h2> Title </h2><p>First  line<!-- no --></p>"
    "<p style='display: none'>gone</p><p hidden>gone</p><div class='sns-share'>Share</div><p>Mail a.b@c.org now</p><img src='/up/photo.jpg' alt='Photo'><img src='/img/logo.png'></div></div><footer>Foot</footer>"
    "<a href='/files/doc.pdf'>Doc</a><a href='mailto:a.b@c.org'>Mail</a></body></html>"
)
_MAIN_ID = "<main id='jwxe_main_content'>short</main><div id='jwxe_main_content'><p>the longer one</p></div>"
_BOARD = (
    "<div class='title-area'><h3> </h3><strong>Notice of the day</strong></div><div class='board-view-information'><dl><dt>작성자</dt><dd>Kim</dd></dl><dl><dt>조회</dt><dd>1,234</dd></dl>"
    "<dl><dt>작성일</dt><dd>2025.03.02 10:00</dd></dl></div><table><tr><th>Day</th><th>Bus</th></tr><tr><td>Mon</td><td>A <b>1</b></td></tr><tr><td> </td><td></td></tr></table>"
    "<a href='?mode=download&articleNo=7'>plan.hwp</a><a href='/cms/fileDownload.do?k=1'>no</a><a href='view.do?x=1'>no</a><img src='img/plan.png' alt=' Plan '><img src='/common/icon.gif'>"
)
_LABELS = "<ul><li><span>작성자</span><em>Lee</em></li><li><span>조회</span><em>77</em></li><li><span>작성일</span><em>2024.1.5</em></li></ul><p class='post-date'>2024-01-05</p>"
_YEAR = (
    "<div class='year-schedule'><div class='schedule-table'><table><tbody><tr><td rowspan=2>2025년 01월</td><td>01.01(수)</td><td>신정</td></tr><tr><td>01.10(금)</td><td>등록</td></tr>"
    "<tr><td>x</td></tr><tr><td>2025년 03월</td><td>03.04(화)</td><td>개강</td></tr><tr><td>03.05</td><td></td></tr></tbody></table></div></div>"
)
_MENU = (
    "<table><tr><td>other</td></tr></table><table><caption>이번 주 식당 메뉴 표</caption><thead><tr><th>월 <br>3.3</th><th>화</th><th> </th></tr></thead><tbody><tr><td><p>중식</p><ul><li>밥</li><li>국</li></ul></td>"
    "<td><p>중식</p><ul><li>면</li></ul></td></tr><tr><td><p>석식</p><ul></ul></td><td><p>석식</p><ul><li>빵</li></ul></td><td><p>x</p><ul><li>y</li></ul></td></tr><tr><td><p>중식</p><ul><li>차</li></ul></td></tr></tbody></table>"
)
_LIST = (
    "<table><tbody><tr><td>1</td><td><a href='?mode=view&articleNo=12'>First  post</a></td><td class=date>2025-01-02</td></tr><tr><td>2</td><td><a href='?mode=view&articleNo=103'>Second</a></td><td>2025-01-01</td></tr>"
    "<tr><td>2</td><td><a href='?mode=view&articleNo=103'>Second</a></td><td>2025-01-01</td></tr><tr><th>점심</th><td>밥</td><td>국</td></tr></tbody></table><ul><li><a href='/p/9'>Nine</a></li></ul>"
)
_ITEMS = "<ul><li><a href='/p/9'>Nine</a> on 2024.5.6</li><li><a href='/p/31?x=7'>Q</a></li><li>none</li></ul><div class='menu'>Soup <b>of</b> the day</div>"
_DAYS = "<table><tr><td><span class='day'>3</span><ul><li>Start</li><li> </li></ul></td><td>4 <ul><li>End</li></ul></td></tr></table>"
_OLD = (
    "<head><base href='http://b/'><link rel='canonical' href=' http://c/x '><meta property='og:url' content='http://o/'><meta property='og:title' content='Shared'></head><body><header>h</header>"
    "<div class='meta'>Fetched at: 2024-05-06T07:08:09</div><div class='meta'>Snapshot of <a href='http://s/'>http://s/</a></div><div role='navigation'>n</div><section>Text <b>here</b></section></body>"
)
PAGES = [
    (1, "http://h.ac.kr/a/b.do", _SITE), (2, "http://h.ac.kr/a/b.do", _MAIN_ID), (3, "http://h.ac.kr/a/b.do?mode=view", _BOARD), (4, "http://h.ac.kr/x", _LABELS), (5, "http://h.ac.kr/x", _YEAR),
    (6, "http://h.ac.kr/x", _MENU), (7, "http://h.ac.kr/list.do", _LIST), (8, "http://h.ac.kr/list.do", _ITEMS), (9, "http://h.ac.kr/x", _DAYS), (10, "http://h.ac.kr/x", _OLD), (11, None, None), (12, "http://h/", "<p>a<p>b"),
]


def _small(spark, *wanted: str) -> DataFrame:
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumn("p", html.parts("html", "url", wanted)).select("page_id", "url", "p.*")


@query(
    rows(
        "page_id long, text string, title string, main_tag string, paragraphs int, links string, images string, words int",
        [
            (1, "Title\nFirst line\nMail a.b@c.org now", "Home | Board", "div", 1, "/files/doc.pdf mailto:a.b@c.org", "/up/photo.jpg=Photo /img/logo.png=", 6),
            (2, "the longer one", "", "div", 1, "", "", 3),
            (12, "a\nb", "", "", 1, "", "", 2),
            (11, "", "", "", 0, "", "", 0),
            (9, "3\nStart\n4\nEnd", "", "", 1, "", "", 4),
        ],
    )
)
def page_contents(spark, d) -> DataFrame:
    """Main text and metadata; elements go by kind, name or because they are hidden."""
    c = _small(spark, "content").filter("page_id in (1, 2, 9, 11, 12)")
    both = lambda a, x, y: F.array_join(F.transform(a, lambda r: F.concat(r[x], F.lit("="), r[y])), " ")
    return c.select("page_id", "content.text", "content.title", F.regexp_replace("content.main_tag", "root", "").alias("main_tag"), "content.paragraphs", F.array_join(F.transform("content.links", lambda a: a["href"]), " ").alias("links"), both("content.images", "src", "alt").alias("images"), F.col("content.word_count").alias("words"))


@query(
    rows(
        "page_id long, title string, snapshot string, text_length int, summary string, area string, redacted boolean",
        [
            (1, "Home | Board", "<body><div class=\"gnb\">Menu</div><div id=\"wrap\"><div class=\"contents\"><h2> Title </h2><p>First  line</p><p style=\"display: none\">gone</p><p hidden=\"\">gone</p><div class=\"sns-share\">Share</div><p>Mail a.b@c.org now</p><img src=\"/up/photo.jpg\" alt=\"Photo\"/><img src=\"/img/logo.png\"/></div></div><a href=\"/files/doc.pdf\">Doc</a><a href=\"mailto:a.b@c.org\">Mail</a></body>", 65, "Title First line gone gone Share Mail [이메일 확인: 원문 참조] now", None, True),
            (3, "", None, None, None, "Notice of the day", False),
            (11, "", "", 0, "", None, False),
        ],
    )
)
def page_snapshots(spark, d) -> DataFrame:
    """Snapshots without what frames them, summaries without addresses of mail, titles' areas."""
    s = _small(spark, "snapshot", "summary", "redacted").filter("page_id in (1, 3, 11)")
    some = lambda c: F.when(F.col("page_id") != 3, F.col(c))
    return s.select("page_id", "snapshot.title", some("snapshot.html").alias("snapshot"), some("snapshot.text_length").alias("text_length"), some("summary.text").alias("summary"), F.col("summary.title_area").alias("area"), (F.contains("redacted", F.lit('data-redacted="email"')) & ~F.contains("redacted", F.lit("@"))).alias("redacted"))


@query(
    rows(
        "page_id long, title string, author string, view_count int, created_at string, any_date string, label_author string, label_views int, label_date string",
        [(3, "Notice of the day", "Kim", 1234, "2025-03-02", "2025-03-02", "Kim", None, None), (4, None, None, None, None, "2024-01-05", "Lee", 77, "2024-1-5"), (12, None, None, None, None, None, None, None, None)],
    )
)
def board_posts(spark, d) -> DataFrame:
    """Title, author, views and date of posts, by the board's head, by wider patterns, by labels."""
    b = _small(spark, "board").filter("page_id in (3, 4, 12)")
    return b.select("page_id", *[F.col(f"board.{c}").alias(c) for c in ("title", "author", "view_count", "created_at", "any_date", "label_author")], F.col("board.label_view_count").alias("label_views"), F.col("board.label_created_at").alias("label_date"))


@query(
    rows(
        "page_id long, pos int, link_text string, download_url string, type string, filename string",
        [
            (1, 0, "Doc", "http://h.ac.kr/files/doc.pdf", "file", "doc.pdf"), (1, 1, "Photo", "http://h.ac.kr/up/photo.jpg", "image", "photo.jpg"),
            (3, 0, "plan.hwp", "http://h.ac.kr/a/b.do?mode=download&articleNo=7", "file", "plan.hwp"), (3, 1, "Plan", "http://h.ac.kr/a/img/plan.png", "image", "plan.png"),
        ],
    )
)
def post_attachments(spark, d) -> DataFrame:
    """Files and pictures of posts, with the names that they would be stored under."""
    a = _small(spark, "attachments").select("page_id", F.posexplode("attachments").alias("pos", "a"))
    return a.select("page_id", "pos", "a.link_text", "a.download_url", "a.type", "a.filename")


@query(
    rows(
        "page_id long, href string, abs_url string, download boolean, allowed boolean, blocked boolean",
        [
            (1, "/files/doc.pdf", "http://h.ac.kr/files/doc.pdf", True, True, False), (1, "mailto:a.b@c.org", "mailto:a.b@c.org", False, False, True),
            (3, "?mode=download&articleNo=7", "http://h.ac.kr/a/b.do?mode=download&articleNo=7", True, False, True), (3, "/cms/fileDownload.do?k=1", "http://h.ac.kr/cms/fileDownload.do?k=1", True, False, True),
            (3, "view.do?x=1", "http://h.ac.kr/a/view.do?x=1", False, False, True),
        ],
    )
)
def page_anchors(spark, d) -> DataFrame:
    """Anchors with what they lead to, and what a policy of prefixes lets through."""
    a = _small(spark, "anchors").filter("page_id in (1, 3)").select("page_id", F.explode("anchors").alias("a")).select("page_id", "a.*")
    return a.select("page_id", "href", "abs_url", pages.download_intent(F.col("href"), F.col("abs_url"), F.col("text"), F.col("class")).alias("download"), pages.may_download(F.col("abs_url"), "allowlist", ["/files"], ["/cms"]).alias("allowed"), pages.may_download(F.col("abs_url"), "blocklist", [], ["/files"]).alias("blocked"))


@query(
    rows(
        "page_id long, pos int, url string",
        [(7, 0, "http://h.ac.kr/list.do?mode=view&articleNo=103"), (7, 1, "http://h.ac.kr/list.do?mode=view&articleNo=103"), (7, 2, "http://h.ac.kr/list.do?mode=view&articleNo=12"), (8, 0, "http://h.ac.kr/p/31?x=7"), (8, 1, "http://h.ac.kr/p/9")],
    )
)
def article_links(spark, d) -> DataFrame:
    """Addresses of a board's articles, newest first."""
    return _small(spark, "article_links").filter("page_id in (7, 8)").select("page_id", F.posexplode("article_links").alias("pos", "url"))


@query(rows("page_id long, line string", [(3, "Day | Bus"), (3, "Mon | A1"), (3, "[표 데이터 시작]"), (3, "[표 데이터 끝]")]))
def tables_as_text(spark, d) -> DataFrame:
    """Tables written out between marks."""
    t = _small(spark, "tables").filter("page_id = 3").select("page_id", F.explode(F.split("tables", "\n")).alias("line"))
    return t.filter("line not like '%<%'")


@query(rows("page_id long, lines string", [(5, "2025년 01월 | 01.01(수) | 신정\n2025년 01월 | 01.10(금) | 등록\n2025년 03월 | 03.04(화) | 개강"), (6, "")]))
def year_schedules(spark, d) -> DataFrame:
    """A year's schedule as lines; rows of two cells are of the month before."""
    return _small(spark, "schedule").filter("page_id in (5, 6)").select("page_id", html.schedule_text(F.col("schedule")).alias("lines"))


@query(rows("page_id long, day string, meal string, dishes string", [(6, "월 3.3", "중식", "밥 / 국 / 차"), (6, "화", "중식", "면"), (6, "화", "석식", "빵")]))
def menu_pivot(spark, d) -> DataFrame:
    """Dishes by day and meal."""
    m = _small(spark, "menu").filter("page_id = 6").select("page_id", F.explode("menu").alias("m"))
    return m.select("page_id", "m.day", "m.meal", F.array_join("m.items", " / ").alias("dishes"))


@query(
    rows(
        "page_id long, kind string, a string, b string, c string",
        [
            (7, "post", "First post", "http://h.ac.kr/list.do?mode=view&articleNo=12", "2025-01-02"), (7, "post", "Second", "http://h.ac.kr/list.do?mode=view&articleNo=103", "2025-01-01"), (7, "post", "Second", "http://h.ac.kr/list.do?mode=view&articleNo=103", "2025-01-01"),
            (7, "dish", "-", "1 / First post / 2025-01-02", None), (7, "dish", "-", "2 / Second / 2025-01-01", None), (7, "dish", "-", "2 / Second / 2025-01-01", None), (7, "dish", "점심", "밥 / 국", None), (7, "row", "First post", "2025-01-02", None), (7, "row", "Second", "2025-01-01", None),
            (8, "post", "Nine", "http://h.ac.kr/p/9", None), (8, "post", "Q", "http://h.ac.kr/p/31?x=7", None), (8, "dish", "-", "Soup of the day", None), (8, "row", "Nine", "2024.5.6", None),
            (9, "dish", "-", "3 Start / 4 End", None), (9, "day", "3", "Start", None), (9, "day", "4 End", "End", None),
        ],
    )
)
def list_parsers(spark, d) -> DataFrame:
    """Posts, dishes, days and plain rows of lists."""
    p = _small(spark, "lists", "rows").filter("page_id in (7, 8, 9)")
    none = F.lit(None).cast("string")
    one = lambda kind, arr, *cols: p.select("page_id", F.lit(kind).alias("kind"), F.explode(arr).alias("x")).select("page_id", "kind", *[(F.col(f"x.{c}") if c else none).alias(n) for c, n in zip(cols, "abc", strict=True)])
    return one("post", "lists.posts", "title", "url", "date").unionByName(one("dish", "lists.dishes", "key", "content", "")).unionByName(one("day", "lists.dates", "date", "title", "")).unionByName(one("row", "rows", "title", "date", ""))


@query(rows("page_id long, address string, title string, text string, selector string, fetched string", [(10, "http://c/x", "Shared", "Text\nhere", "section", "2024-05-06"), (12, "", "", "a\nb", "root", "")]))
def saved_pages(spark, d) -> DataFrame:
    """Where saved pages came from, when, and their text as the older corpus took it."""
    from lectern.operators.documents import best_address

    o = _small(spark, "old").filter("page_id in (10, 12)")
    return o.select("page_id", best_address(F.col("old")).alias("address"), "old.title", "old.text", "old.selector", "old.fetched")
