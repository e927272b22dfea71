"""Cases by hand: from raw records to documents, of attachments, addresses, robots and texts, over rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import urls
from lectern.operators import documents as docs
from lectern.operators import intents, pages, tables
from lectern.plans import rows

from hand_pages import query
from lectern.sources import readers

_POST = "제목 줄\n작성자\nKim\n조회\n1,204\n작성자\nPark\n작성일\n2025.03.02\n본문 첫 줄입니다\n둘째 줄\n이전글 없음\n끝"
_SCHEDULE = "번호\n제목\n시작일\n종료일\n등록일\n조회\n2\n개강\n2025-03-04\n2025-03-04\n2025-01-01\n10\n1\n수강신청\n2025-02-10\n2025-02-14\n2025-01-01\n20\nx\ny\nz"
RAW = [
    ("http://cs.h.ac.kr/cs/notice.do?mode=view&articleNo=77", "소식 | 공지 | 일반", None, _POST, None, None, "2025-01-01T02:03:04"),
    ("http://h.ac.kr/a/schedule.do?page=2", "", None, _SCHEDULE, "2025.1.5", None, None),
    ("http://h.ac.kr/a/b/", "제목만", "old text", "", "2025-13-01", "2024-12-31T10:00", None),
    ("http://h.ac.kr/", None, "[표 데이터 시작]\n한 줄\n[표 데이터 끝]", None, None, None, None),
]


def _raw(spark) -> DataFrame:
    schema = "url string, title string, text string, main_text string, created_at string, meta_date string, crawled_at string"
    df = spark.createDataFrame(RAW, schema)
    att = F.array().cast(f"array<{readers.ATTACHMENT}>")
    meta = F.struct(F.lit(None).cast("string").alias("title"), F.col("meta_date").alias("created_at"), F.lit(None).cast("string").alias("post_date"), F.lit(None).cast("string").alias("crawled_at"), F.lit(5).alias("text_length"), att.alias("attachments"))
    return df.withColumn("attachments", att).withColumn("metadata", meta)


@query(
    rows(
        "doc_id string, site string, board_name string, title string, author string, view_count int, created_at string, main_text string, tags string, crawled_at string",
        [
            ("cs_notice_77", "소식", "공지 | 일반", "소식 | 공지 | 일반", "Park", 1204, "2025-03-02", "2025.03.02\n본문 첫 줄입니다\n둘째 줄", None, "2025-01-01T02:03:04"),
            ("h_schedule_p2", "a", "schedule.do", "번호", None, 2, "2025-01-05", "이 문서는 schedule.do 정보입니다.\n주요 일정은 다음과 같습니다.\n\n• 개강: 2025-03-04 (하루)\n• 수강신청: 2025-02-10 ~ 2025-02-14", "학사일정,일정표,주요학사일정,개강,종강,시험기간", None),
            ("h_b", "제목만", "b", "제목만", None, None, "2024-12-31", "old text", None, None),
            ("h_index", None, None, "[표 데이터 시작]", None, None, None, "한 줄", None, None),
        ],
    )
)
def unified_records(spark, d) -> DataFrame:
    """Raw records of a crawl as unified documents."""
    u = docs.unify_raw(_raw(spark))
    return u.select("doc_id", "site", "board_name", "title", "author", "view_count", "created_at", "main_text", F.array_join("tags", ",").alias("tags"), "crawled_at")


_PARENTS = [
    (1, "T1", "http://h/1", "B", "2025-01-01", [("o/a_1.txt", "a.txt"), ("o/b.pdf", "b.pdf"), ("o/c.do", "c.png"), (None, "x.pdf"), ("o/z", "z.hwp")]),
    (2, None, None, None, None, [("o/b.pdf", "b2.pdf"), ("o/short.pdf", "s.pdf"), ("o/gone.pdf", "g.pdf"), ("o/scan_ab12.pdf", "scan.pdf")]),
    (3, "T3", "http://h/3", "B", None, []),
]
_OBJECTS = [("o/b.pdf", "b" * 60), ("o/short.pdf", "abc"), ("o/scan.pdf", "thin"), ("o/z", "한글 문서"), ("o/c.do", "pixels")]


@query(
    rows(
        "doc_id string, title string, display_title string, url string, board_name string, created_at string, main_text string, doc_type string, tags string, parent_title string",
        [
            ("att_c4ca", "[첨부파일] z.hwp", "z.hwp (출처: T1)", "http://h/1", "B", "2025-01-01", "한글 문서", "hwp", "첨부파일,.HWP", "T1"),
            ("att_b.pdf", "[첨부파일] b2.pdf", "b2.pdf (출처: 제목 없음)", "", "첨부파일", None, "b" * 60, "pdf", "첨부파일,.PDF", None),
            ("att_scan", "[첨부파일] scan.pdf", "scan.pdf (출처: 제목 없음)", "", "첨부파일", None, "read: thin", "pdf", "첨부파일,.PDF", None),
            ("att_short", "[첨부파일] s.pdf", "s.pdf (출처: 제목 없음)", "", "첨부파일", None, "read: abc", "pdf", "첨부파일,.PDF", None),
        ],
    ).replace("'att_c4ca'", "'att_' || left(md5('o/z'), 16)").replace("'att_b.pdf'", "'att_' || left(md5('o/b.pdf'), 16)").replace("'att_scan'", "'att_' || left(md5('o/scan_ab12.pdf'), 16)").replace("'att_short'", "'att_' || left(md5('o/short.pdf'), 16)")
)
def attached_documents(spark, d) -> DataFrame:
    """Attachments with their objects' text as documents; an object's name is tried without its suffix; thin PDFs are read as
    pictures."""
    kind = f"array<{readers.ATTACHMENT}>"
    parents = spark.createDataFrame(_PARENTS, "id long, title string, url string, board_name string, created_at string, a array<struct<minio_object:string,filename:string>>")
    full = F.from_json(F.to_json("a"), kind)
    attached = docs.exploded(parents.withColumn("attachments", full))
    objects = spark.createDataFrame(_OBJECTS, "object string, content string").withColumn("content", F.col("content").cast("binary"))
    text = lambda c: docs.plain_text(c)
    got = docs.fetched(attached, objects).withColumn("content_text", docs.extracted(F.col("content"), F.col("ext"), {"txt": text, "pdf": text, "hwp": text}, lambda c: F.when(F.length(c) < 50, F.concat(F.lit("read: "), c.cast("string")))))
    out = docs.attachment_documents(got.filter("ext <> 'png'"))
    return out.select("doc_id", "title", "display_title", "url", "board_name", "created_at", "main_text", "doc_type", F.array_join("tags", ",").alias("tags"), "parent_title")


@query(
    rows(
        "url string, key string, site string, type string, words int, fields string, joined string",
        [
            ("https://bus.h.ac.kr/bus/notice.do?mode=view&articleNo=5", "bus_notice_5", "bus", "board", 0, "bus.h.ac.kr|/bus/notice.do|bus|bus_h_ac_kr_bus_notice_do", "https://bus.h.ac.kr/bus/x/y.do?a=1&b=2"),
            ("https://h.org/a/b.jsp", "h.org_page_a_b", "h.org", "page", 3, "h.org|/a/b.jsp|a|h_org_a_b_jsp", "https://h.org/a/x/y.do?a=1&b=2"),
            ("https://h.org", "h.org_page_root", "h.org", "page", 0, "h.org|/||h_org", "https://h.org/x/y.do?a=1&b=2"),
            ("", "_page_root", "", "page", 1, "|||file_1", "/x/y.do?a=1&b=2"),
        ],
    )
)
def page_keys(spark, d) -> DataFrame:
    """Keys, sites, fields and types of pages, and links as seen from them."""
    rows_ = [("https://bus.h.ac.kr/bus/notice.do?mode=view&articleNo=5", "", "board_notice"), ("https://h.org/a/b.jsp", "one two  three", "page"), ("https://h.org", "", "page"), ("", "x", "page")]
    df = spark.createDataFrame(rows_, "url string, text string, kind string").withColumn("images", F.array(F.lit("i")))
    p = docs.page_documents(df, F.col("kind")).withColumn("f", urls.fields("url", F.lit("File 1.html")))
    return p.select("url", F.col("doc_id").alias("key"), "site", F.col("source_type").alias("type"), F.col("word_count").alias("words"), F.concat_ws("|", "f.domain", "f.source_path", "f.section", "f.doc_id").alias("fields"), urls.resolve("url", F.lit("x/./z/../y.do?b=2&a=1#top")).alias("joined"))


@query(
    rows(
        "href string, joined string",
        [("b.do", "http://h/p/b.do"), ("../b", "http://h/b"), ("/c/", "http://h/c/"), ("?x=1", "http://h/p/a.do?x=1"), ("//o/x", "http://o/x"), ("https://o/y#z", "https://o/y"), ("", "http://h/p/a.do?q=0"), ("mailto:a@b", "mailto:a@b"), ("d/..", "http://h/p/")],
    )
)
def joined_links(spark, d) -> DataFrame:
    """Links of every form as seen from a page."""
    hrefs = ["b.do", "../b", "/c/", "?x=1", "//o/x", "https://o/y#z", "", "mailto:a@b", "d/.."]
    return spark.createDataFrame([(h,) for h in hrefs], "href string").select("href", urls.joined(F.lit("http://h/p/a.do?q=0"), "href").alias("joined"))


@query(
    rows(
        "host string, path string, permitted boolean, delay double",
        [("a", "/x", True, 2.0), ("a", "/private/x", False, 2.0), ("a", "/private/open/1", True, 2.0), ("b", "/any", False, 0.0), ("b", "/", False, 0.0), ("c", "/any", True, 0.0)],
    )
)
def robots_rules(spark, d) -> DataFrame:
    """What robots files permit an agent: the longest rule, its own rules before those for any."""
    texts = spark.createDataFrame([("a", "# no\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /"), ("b", "User-agent: *\nAllow: /\n\nUser-agent: Ours\nDisallow: /")], "host string, text string")
    asked = spark.createDataFrame([("a", "/x"), ("a", "/private/x"), ("a", "/private/open/1"), ("b", "/any"), ("b", "/"), ("c", "/any")], "host string, path string")
    asked = asked.withColumn("url", F.concat(F.lit("http://"), "host", "path"))
    return readers.permitted(asked, readers.robots(spark, texts), "Ours/1.0").select("host", "path", "permitted", "delay")


@query(rows("loc string", [("https://h/ko/a.do",), ("https://h/ko/b.do",)]))
def static_addresses(spark, d) -> DataFrame:
    """Plain pages of a sitemap."""
    every = ["http://h/ko/a.do", "https://h/ko/a.do/", "https://h/ko/b.do", "https://h/en/c.do", "https://h/ko/x.do?mode=view", "https://h/ko/login.do", "https://h/ko/f.PDF", "https://h/ko/d.do#x", "https://h/ko/gone.do", "https://h/ko/board.do"]
    df = spark.createDataFrame([(u,) for u in every], "loc string")
    return readers.static_pages(df, "https://h/ko/", df.filter("loc like '%gone%'"))


@query(rows("url string, title string, out boolean", [("/sub07_04_01.do", "x", True), ("/notice.do", "x", True), ("/notice.do/1", "x", False), ("/a", "개인정보처리방침 안내", True), ("/a", None, False)]))
def excluded_pages(spark, d) -> DataFrame:
    """Pages that a corpus leaves out by path or title."""
    df = spark.createDataFrame([("/sub07_04_01.do", "x"), ("/notice.do", "x"), ("/notice.do/1", "x"), ("/a", "개인정보처리방침 안내"), ("/a", None)], "url string, title string")
    return df.select("url", "title", docs.excluded(F.col("url"), F.col("title"), [r"/sub07_04_01\.do", r"/notice\.do$"], ["개인정보처리방침", "이메일무단수집거부"]).alias("out"))


# texts --------------------------------------------------------------------------------------------------------------------

_NOISY = "공지사항 목록 바로가기 본문입니다 top ↑\n목 차\n12\n- 3 -\n페이지 4\n저작권 안내\nCopyright 2020 all rights reserved 끝\n목록으로 [ 인쇄 ] 남는 줄"


@query(
    rows(
        "id int, corpus string, lines string, old string, filtered string, page string, lang string",
        [
            (1, "본문입니다 목 차 12 - 3 - 페이지 4 저작권 안내 끝 남는 줄", "공지사항 목록 바로가기 본문입니다 top ↑ 목록으로 [ 인쇄 ] 남는 줄", _NOISY, "본문입니다 \n목 차\n12\n- 3 -\n페이지 4\n저작권 안내\n 끝\n  남는 줄", _NOISY, "ko"),
            (2, "Fetched at: now HOME body", "Fetched at: now HOME body", "body", "Fetched at: now\nHOME body", "Fetched at: now\nHOME body", "en"),
            (3, "a b", "a b", "a\n\nb", "a\n\nb", "a\nb", "en"),
            (4, "", "", None, "", "", None),
        ],
    )
)
def korean_cleaners(spark, d) -> DataFrame:
    """The text cleaners on noise of Korean sites, one by one."""
    df = spark.createDataFrame([(1, _NOISY), (2, "Fetched at: now\nHOME  \tbody"), (3, " a\n\n\n\n\nb "), (4, None)], "id int, t string")
    return df.select("id", tx.clean_corpus("t").alias("corpus"), tx.clean_lines("t").alias("lines"), tx.clean_old("t").alias("old"), tx.clean_filtered("t").alias("filtered"), tx.clean_page_lines(F.regexp_replace("t", "\t", "")).alias("page"), F.when(F.col("t").isNotNull(), tx.guess_lang("t")).alias("lang"))


@query(
    rows(
        "id int, title string, first string, last string, post string, finished string, rewritten string, key string",
        [
            (1, "수강신청 안내", "2025-2-10", "2025-02-14", "2025-02-14", "수강신청 안내\n2025년 2월 10일부터 2025-02-14까지", "수강신청 안내\\n2025년 2월 10일부터 2025-02-14까지 ", "수강신청 안내\\n2025년 2월 10일부터 2025-02-14까지 || x"),
            (2, "no date", None, None, None, "no date", "asked", "no date|| x"),
            (3, None, None, None, None, "", "", "|| x"),
        ],
    )
)
def answer_texts(spark, d) -> DataFrame:
    """Dates and titles of answers, their last touches, rewritten questions, keys of rows."""
    df = spark.createDataFrame([(1, "수강신청 안내\\n2025년 2월 10일부터 2025-02-14까지 "), (2, "no date"), (3, "")], "id int, t string")
    done = tx.finished_answer("t")
    s = df.withColumn("done", done).withColumn("s", tx.schedule_dates("done"))
    return s.select("id", "s.title", F.col("s.start").alias("first"), F.col("s.end").alias("last"), tx.post_date("t").alias("post"), F.col("done").alias("finished"), tx.rewritten("t", {"no date": "asked"}).alias("rewritten"), tx.row_key("t", F.lit(" X")).alias("key"))


@query(
    rows(
        "raw string, fixed string, typed string, project string",
        [("%EA%B3%B5+a%3F.pdf", "공+a_.pdf", "%EA%B3%B5+a%3F.pdf", "%EA%B3%B5+a%3F.pdf"), ("a/b  c", "b c.bin", "a/b  c.jpg", "a/b  c"), ("x.do", "x.do", "x.jpg", "x.do"), ("C:\\k\\data\\x.html", "C__k_data_x.html", "C:\\k\\data\\x.html", "data/x.html")],
    )
)
def file_names(spark, d) -> DataFrame:
    """File names repaired, completed by type, and cut to the project."""
    df = spark.createDataFrame([("%EA%B3%B5+a%3F.pdf",), ("a/b  c",), ("x.do",), ("C:\\k\\data\\x.html",)], "raw string")
    return df.select("raw", tx.fixed_name("raw").alias("fixed"), tx.with_ending("raw", F.lit("image/jpeg; q=1")).alias("typed"), tx.path_in_project("raw", "data").alias("project"))


@query(
    rows(
        "id int, text string, passage string, question string, plain string, day string, before string",
        [(1, "T\nbody", "passage: T\nbody", "query: T\nbody", "T\nbody", "2025-01-01", "2024-07-05"), (2, "", "passage: ", "query: ", "", "2025-01-01", "2024-07-05")],
    )
)
def embedding_inputs(spark, d) -> DataFrame:
    """Texts for encoders, and the day in another zone."""
    df = spark.createDataFrame([(1, " T ", None, "body and more"), (2, "", " ", None)], "id int, a string, b string, c string").withColumn("t", tx.embedding_text("a", "b", F.left("c", F.lit(4))))
    day = urls.today_in("Asia/Seoul", F.lit("2024-12-31 16:00:00").cast("timestamp"))
    return df.select("id", F.col("t").alias("text"), tx.prefixed("t", "e5-base", "passage").alias("passage"), tx.prefixed("t", "E5", "query").alias("question"), tx.prefixed("t", "bge", "query").alias("plain"), F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(urls.months_ago(day, 6), "yyyy-MM-dd").alias("before"))


@query(
    rows(
        "id int, intent string, keyword string, alert string, refuses boolean, boosted double, site string",
        [
            (1, "bus", "교통/셔틀버스", None, False, 0.6, "bus"), (2, "schedule", "학사일정", "COURSE", False, 0.65, None), (3, "menu", "식단", None, False, 0.7, None), (4, "scholarship", "장학", "SCHOLARSHIP", False, 0.6, None),
            (5, "dorm", "생활관/기숙사", "DORM", False, 0.6, None), (6, "employment", "취업/채용", "EMPLOYMENT", False, 0.6, None), (7, "event", "행사/특강", "EVENT", False, 0.55, None), (8, "chitchat", "인사/잡담", None, False, 0.5, None),
            (9, "general", "죄송하지만 문서에", None, True, 0.5, None), (10, "general", "도서관 위치", None, False, 0.5, None), (11, "schedule", "학사일정", None, False, 0.5, "main"),
        ],
    ).replace("'죄송하지만 문서에'", "'죄송하지만 문서에 '")
)
def korean_intents(spark, d) -> DataFrame:
    """Intents, keywords, alerts, refusals, the rules' bonuses and routes of Korean questions, a question an intent."""
    asked = [
        (1, "셔틀버스 시간", "버스", "", ""), (2, "수강신청 언제", "", "학사일정", ""), (3, "오늘 학식", "", "", "http://h/restaurant01.do"), (4, "장학 안내", "", "장학 소식", ""), (5, "기숙사 입사", "생활관", "", ""),
        (6, "현장실습 인턴", "", "취업", ""), (7, "축제 행사", "", "비교과", ""), (8, "안녕 반가워", "", "", ""), (9, "죄송하지만 문서에 없습니다", "", "", ""), (10, "도서관 위치", "", "", ""), (11, "계절수업 등록금", "", "", ""),
    ]
    df = spark.createDataFrame(asked, "id int, text string, site string, board_name string, url string").withColumns({"title": F.lit(""), "source_type": F.lit("board"), "intent": intents.classify(F.col("text"))})
    rules = spark.createDataFrame([(n, k, a, x) for n, k, a, x in intents.ROUTES], "name string, site_key string, keywords_any array<string>, exclude_keywords_any array<string>")
    routed = tables.route(df.select("id", "text"), rules).select("id", "site_key")
    out = df.select("id", "intent", intents.shown_keyword(F.col("text"), F.col("intent")).alias("keyword"), intents.alert(F.col("text")).alias("alert"), intents.refuses(F.col("text")).alias("refuses"), F.round(intents.boost(F.lit(0.5), F.col("intent")), 6).alias("boosted"))
    return out.join(routed, "id", "left").withColumnRenamed("site_key", "site")


@query(
    rows(
        "id int, reason string, login boolean, icon boolean, recent boolean",
        [(1, "too_short", False, True, True), (2, "too_long", True, False, False), (3, "few_words", False, False, True), (4, "error_page", True, True, True), (5, "no_title", False, False, True), (6, "white_space", False, False, False), (7, "OK", False, False, True)],
    )
)
def page_gates(spark, d) -> DataFrame:
    """Every reason for which a page is left out, login pages, icons and old dates."""
    words = "word " * 30
    cases = [
        (1, "short", "T", "http://h/", "<p>", "/img/logo.png", None), (2, words * 4000, "T", "http://h/Login.do", "<p>", "/a.png", "2020-12-31"), (3, "w" * 200, "T", "http://h/", "<p>", "/b", "2021-01-01T00:00:00Z"),
        (4, words + " Access Denied ", "T", "http://h/", "<div class='x login-wrapper'>", "/BTN.gif", "nonsense"), (5, words, " T", "http://h/", "<p id='logo'>", "/c", None), (6, "a " * 30 + " " * 80, "Title", "http://h/", "<p>", "/d", "2020-01-01"),
        (7, words, "Title", "http://h/", "<p>", "/e", "2022-01-01"),
    ]
    df = spark.createDataFrame(cases, "id int, text string, title string, url string, html string, src string, at string")
    return df.select("id", pages.quality_reason(F.col("text"), F.col("title")).alias("reason"), pages.is_login(F.col("url"), F.col("html")).alias("login"), pages.is_icon(F.col("src")).alias("icon"), pages.recent(F.col("at"), "2021-01-01").alias("recent"))
