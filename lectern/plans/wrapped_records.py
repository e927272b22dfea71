"""Queries from raw records to documents, of attachments, addresses, robots, names and texts: records are wrapped around the values of
given rows, and SQL says what should come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import urls
from lectern.operators import chunking, intents, pages, tables
from lectern.operators import documents as docs
from lectern.plans import query
from lectern.plans.wrapped import filled, wanted
from lectern.sources import readers, writers
from lectern.sources.readers import table
from lectern.sources.shared import new_path


def _rows(spark, d, **columns: str) -> DataFrame:
    """A row for each of ``documents``: templates, or expressions after an equals sign."""
    return table(spark, d, "documents").select("doc_id", *[F.expr(v[1:] if v.startswith("=") else filled(v)).alias(c) for c, v in columns.items()])


def _cases(**by: str) -> str:
    """SQL that is one template for each rest of the id."""
    return "=CASE " + " ".join(f"WHEN doc_id % {len(by)} = {k} THEN {v[1:] if v.startswith('=') else filled(v)}" for k, v in enumerate(by.values())) + " END"


# raw records ----------------------------------------------------------------------------------------------------------------

_POST = "제목 줄\n작성자\nKim\n조회\n1,204\n작성자\n{s}\n작성일\n{y}.{mm}.{dd}\n본문 {m}입니다\n둘째 줄\n이전글 없음\n끝"
_SCHEDULE = "번호\n제목\n시작일\n종료일\n등록일\n조회\n{k}\n개강 {m}\n{y}-03-04\n{y}-03-04\n2025-01-01\n10\n1\n수강신청\n{y}-02-10\n{y}-02-14\n2025-01-01\n20\nx\ny\nz"
_UNIFIED = ("doc_id", "site", "board_name", "title", "author", "view_count", "created_at", "main_text", "tags", "crawled_at")


def _unified(spark, d, **columns: str) -> DataFrame:
    raw = _rows(spark, d, **columns).withColumnRenamed("doc_id", "id")
    for c in ("url", "title", "text", "main_text", "created_at", "crawled_at"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    none, att = F.lit(None).cast("string"), F.array().cast(f"array<{readers.ATTACHMENT}>")
    meta = F.struct(none.alias("title"), none.alias("created_at"), none.alias("post_date"), none.alias("crawled_at"), F.lit(5).alias("text_length"), att.alias("attachments"))
    u = docs.unify_raw(raw.withColumn("attachments", att).withColumn("metadata", meta))
    return u.select(*[F.array_join("tags", ",").alias(c) if c == "tags" else c for c in _UNIFIED])


def _as_unified(sql: str) -> str:
    """``wanted`` whose ``key`` is the document's id."""
    return f"SELECT key AS doc_id, {', '.join(_UNIFIED[1:])} FROM ({sql})"


_NULL = "=cast(NULL as string)"


@query(_as_unified(wanted(key="cs_notice_{id}", site="소식", board_name="공지 | {l}", title="소식 | 공지 | {l}", author="{s}", view_count="=1204", created_at="{y}-{mm}-{dd}", main_text="{y}.{mm}.{dd}\n본문 {m}입니다\n둘째 줄", tags=_NULL, crawled_at="{y}-01-01T02:03:04")))
def unified_records(spark, d) -> DataFrame:
    """Posts of boards as unified documents: key, head, date, body."""
    return _unified(spark, d, url="http://cs.h.ac.kr/cs/notice.do?mode=view&articleNo={id}", title="소식 | 공지 | {l}", main_text=_POST, crawled_at="{y}-01-01T02:03:04")


_TOLD = "이 문서는 schedule.do 정보입니다.\n주요 일정은 다음과 같습니다.\n\n• 개강 {m}: {y}-03-04 (하루)\n• 수강신청: {y}-02-10 ~ {y}-02-14"


@query(_as_unified(wanted(key="h_schedule_p{id}", site="a", board_name="schedule.do", title="번호", author=_NULL, view_count="=cast(doc_id % 9 + 1 as int)", created_at="{y}-01-05", main_text=_TOLD, tags="학사일정,일정표,주요학사일정,개강,종강,시험기간", crawled_at=_NULL)))
def unified_schedules(spark, d) -> DataFrame:
    """Schedules as unified documents: rows of dates as sentences, tags."""
    return _unified(spark, d, url="http://h.ac.kr/a/schedule.do?page={id}", title="", main_text=_SCHEDULE, created_at="{y}.1.5")


def _attached(name: str, shown: str, text: str, kind: str) -> str:
    return wanted(key=f"='att_' || left(md5({filled(name)}), 16)", title=f"[첨부파일] {shown}", display_title=f"{shown} (출처: T{{id}})", url="http://h/{id}", board_name="{s}", created_at="{y}-{mm}-{dd}", main_text=text, doc_type=kind, tags=f"첨부파일,.{kind.upper()}", parent_title="T{id}")


_LONG = "b" * 60


@query(" UNION ALL ".join(f"SELECT * EXCLUDE (doc_id, key), key AS doc_id FROM ({x})" for x in (_attached("o/b{id}.pdf", "b{k}.pdf", _LONG + "{m}", "pdf"), _attached("o/s{id}_ab12.pdf", "s.pdf", "read: {k}", "pdf"), _attached("o/z{id}", "z{k}.hwp", "한글 문서 {m}", "hwp"))))
def attached_documents(spark, d) -> DataFrame:
    """Attachments with their objects' text as documents; an object's name is tried without its suffix; thin PDFs are read as
    pictures; what has no object, no name, or is of no known kind is left out."""
    parents = _rows(spark, d, title="T{id}", url="http://h/{id}", board_name="{s}", created_at="{y}-{mm}-{dd}", b="o/b{id}.pdf", bn="b{k}.pdf", s="o/s{id}_ab12.pdf", z="o/z{id}", zn="z{k}.hwp", g="o/gone{id}.pdf").withColumnRenamed("doc_id", "id")
    one = lambda o, n: F.struct(F.col(o).alias("minio_object") if isinstance(o, str) else o.alias("minio_object"), (F.col(n) if n in ("bn", "zn") else F.lit(n)).alias("filename"))
    every = F.array(one("b", "bn"), one("s", "s.pdf"), one("z", "zn"), one("g", "g.pdf"), one(F.lit(None).cast("string"), "x.pdf"), one("z", "t.txt"))
    attached = docs.exploded(parents.withColumn("attachments", F.from_json(F.to_json(every), f"array<{readers.ATTACHMENT}>")).drop("b", "bn", "s", "z", "zn", "g"))
    objects = None
    for name, text in (("o/b{id}.pdf", _LONG + "{m}"), ("o/s{id}.pdf", "{k}"), ("o/z{id}", "한글 문서 {m}")):
        part = _rows(spark, d, object=name, content=text).select("object", F.col("content").cast("binary").alias("content"))
        objects = part if objects is None else objects.unionByName(part)
    text = lambda c: docs.plain_text(c)
    got = docs.fetched(attached, objects).withColumn("content_text", docs.extracted(F.col("content"), F.col("ext"), {"pdf": text, "hwp": text}, lambda c: F.when(F.length(c) < 50, F.concat(F.lit("read: "), c.cast("string")))))
    out = docs.attachment_documents(got)
    return out.select("doc_id", "title", "display_title", "url", "board_name", "created_at", "main_text", "doc_type", F.array_join("tags", ",").alias("tags"), "parent_title")


# addresses ----------------------------------------------------------------------------------------------------------------------


@query(
    " UNION ALL ".join(
        f"SELECT * EXCLUDE (doc_id) FROM ({x})"
        for x in (
            wanted(url="https://bus.h.ac.kr/bus/notice.do?mode=view&articleNo={id}", key="bus_notice_{id}", site="bus", type="board", words="=3", fields="bus.h.ac.kr|/bus/notice.do|bus|bus_h_ac_kr_bus_notice_do", joined="https://bus.h.ac.kr/bus/x/y.do?a=1&b=2"),
            wanted(url="https://h.org/a{k}/b{id}.jsp", key="h.org_page_a{k}_b{id}", site="h.org", type="page", words="=3", fields="h.org|/a{k}/b{id}.jsp|a{k}|h_org_a{k}_b{id}_jsp", joined="https://h.org/a{k}/x/y.do?a=1&b=2"),
        )
    )
)
def page_keys(spark, d) -> DataFrame:
    """Keys, sites, fields and types of pages, and links as seen from them."""
    both = None
    for url, kind in (("https://bus.h.ac.kr/bus/notice.do?mode=view&articleNo={id}", "board_notice"), ("https://h.org/a{k}/b{id}.jsp", "page")):
        part = _rows(spark, d, url=url, text="one {m}  three", kind=kind).drop("doc_id")
        both = part if both is None else both.unionByName(part)
    p = docs.page_documents(both.withColumn("images", F.array(F.lit("i"))), F.col("kind")).withColumn("f", urls.fields("url", F.lit("File 1.html")))
    return p.select("url", F.col("doc_id").alias("key"), "site", F.col("source_type").alias("type"), F.col("word_count").alias("words"), F.concat_ws("|", "f.domain", "f.source_path", "f.section", "f.doc_id").alias("fields"), urls.resolve("url", F.lit("x/./z/../y.do?b=2&a=1#top")).alias("joined"))


_LINKS = [
    ("b{id}.do", "http://h/p{k}/b{id}.do"), ("../b{id}", "http://h/b{id}"), ("/c{id}/", "http://h/c{id}/"), ("?x={id}", "http://h/p{k}/a.do?x={id}"), ("//o/x{id}", "http://o/x{id}"), ("https://o/y{id}#z", "https://o/y{id}"),
    ("", "http://h/p{k}/a.do?q={id}"), ("mailto:a{id}@b", "mailto:a{id}@b"), ("d{id}/..", "http://h/p{k}/"),
]


@query(" UNION ALL ".join(wanted(href=h if h else "=''", joined=j) for h, j in _LINKS))
def joined_links(spark, d) -> DataFrame:
    """Links of every form as seen from a page."""
    every = F.array(*[F.expr(filled(h)) if h else F.lit("") for h, _ in _LINKS])
    df = table(spark, d, "documents").select("doc_id", F.expr(filled("http://h/p{k}/a.do?q={id}")).alias("base"), F.explode(every).alias("href"))
    return df.select("doc_id", "href", urls.joined(F.col("base"), "href").alias("joined"))


_ROBOTS = "# no\nUser-agent: *\nDisallow: /private{k}\nAllow: /private{k}/open\nCrawl-delay: {k}\n\nUser-agent: other\nDisallow: /"
_ASKED = [("/x{id}", "true"), ("/private{k}/x", "false"), ("/private{k}/open/{id}", "true")]


@query(" UNION ALL ".join(wanted(path=p, permitted=f"={ok}", delay="=cast(doc_id % 9 + 1 as double)") for p, ok in _ASKED))
def robots_rules(spark, d) -> DataFrame:
    """What robots files permit an agent, a host for each document: the longest rule decides."""
    texts = _rows(spark, d, host="h{id}", text=_ROBOTS)
    asked = table(spark, d, "documents").select("doc_id", F.expr(filled("http://h{id}")).alias("base"), F.explode(F.array(*[F.expr(filled(p)) for p, _ in _ASKED])).alias("path")).withColumn("url", F.concat("base", "path"))
    return readers.permitted(asked, readers.robots(spark, texts), "Ours/1.0").select("doc_id", "path", "permitted", "delay")


@query("SELECT 'https://h/ko/a' || doc_id || '.do' AS loc FROM documents WHERE doc_id % 7 IN (0, 1)")
def static_addresses(spark, d) -> DataFrame:
    """Plain pages of a sitemap: right scheme and folder, no query, no login, no file, not among those that go."""
    df = _rows(spark, d, loc=_cases(a="http://h/ko/a{id}.do", b="https://h/ko/a{id}.do/", c="https://h/en/c{id}.do", e="https://h/ko/x{id}.do?mode=view", f="https://h/ko/f{id}.PDF", g="https://h/ko/login{id}.do", h="https://h/ko/gone{id}.do"))
    return readers.static_pages(df.select("loc"), "https://h/ko/", df.filter("loc like '%gone%'").select("loc"))


@query(wanted(url=_cases(a="/sub07_04_01.do", b="/x{id}/notice.do", c="/notice.do/{id}", e="/a{id}"), out="=doc_id % 4 <> 2"))
def excluded_pages(spark, d) -> DataFrame:
    """Pages that a corpus leaves out by path or title."""
    df = _rows(spark, d, url=_cases(a="/sub07_04_01.do", b="/x{id}/notice.do", c="/notice.do/{id}", e="/a{id}"), title=_cases(a="{m}", b="{m}", c="{m}", e="개인정보처리방침 {m}"))
    return df.select("doc_id", "url", docs.excluded(F.col("url"), F.col("title"), [r"/sub07_04_01\.do", r"/notice\.do$"], ["개인정보처리방침", "이메일무단수집거부"]).alias("out"))


_HASH = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url))"


@query(f"SELECT url, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17])::INT % 4 AS INT) + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM (SELECT url, {_HASH} AS h FROM pages)")
def url_ids(spark, d) -> DataFrame:
    """Version 5 UUIDs of addresses."""
    return table(spark, d, "pages").select("url", urls.uuid5("url").alias("uuid"))


# texts ------------------------------------------------------------------------------------------------------------------------

_NOISY = "공지사항 목록 바로가기 본문 {m}입니다 top ↑\n목 차\n12\n- 3 -\n페이지 4\n저작권 안내\nCopyright 2020 all rights reserved 끝{k}\n목록으로 [ 인쇄 ] 남는 줄"


@query(
    wanted(
        corpus="본문 {m}입니다 목 차 12 - 3 - 페이지 4 저작권 안내 끝{k} 남는 줄", lines="공지사항 목록 바로가기 본문 {m}입니다 top ↑ 목록으로 [ 인쇄 ] 남는 줄", old=_NOISY,
        filtered="본문 {m}입니다 \n목 차\n12\n- 3 -\n페이지 4\n저작권 안내\n 끝{k}\n  남는 줄", page=_NOISY, lang="ko",
    )
)
def korean_cleaners(spark, d) -> DataFrame:
    """The text cleaners on noise of Korean sites, one by one."""
    df = _rows(spark, d, t=_NOISY)
    return df.select("doc_id", tx.clean_corpus("t").alias("corpus"), tx.clean_lines("t").alias("lines"), tx.clean_old("t").alias("old"), tx.clean_filtered("t").alias("filtered"), tx.clean_page_lines("t").alias("page"), tx.guess_lang("t").alias("lang"))


@query(wanted(clean="{y}.01.05\n본문 내용이 여기에 {m}\n칸{k}"))
def cleaned_posts(spark, d) -> DataFrame:
    """Posts without head and tail."""
    df = _rows(spark, d, t="제목\n작성자\n{s}\n조회\n5\n작성일\n{y}.01.05\n본문 내용이 여기에 {m}\n\n[표 데이터 시작]칸{k}[표 데이터 끝]\n이전글 무엇\n뒤")
    return df.select("doc_id", tx.clean_post("t").alias("clean"))


_END = "{y}년 {mm}월 {dd}일부터 {y}-02-14까지"


@query(wanted(title="안내 {m}", first="{y}-{mm}-{dd}", last="{y}-02-14", post="{y}-02-14", finished="안내 {m}\n" + _END, rewritten="안내 {m}{bs}n" + _END + " ", key="안내 {m}{bs}n" + _END + " || x{id}"))
def answer_texts(spark, d) -> DataFrame:
    """Dates and titles of answers, their last touches, rewritten questions, keys of rows."""
    df = _rows(spark, d, t="안내 {m}{bs}n" + _END + " ", x=" X{id}")
    s = df.withColumn("done", tx.finished_answer("t")).withColumn("s", tx.schedule_dates("done"))
    return s.select("doc_id", "s.title", F.col("s.start").alias("first"), F.col("s.end").alias("last"), tx.post_date("t").alias("post"), F.col("done").alias("finished"), tx.rewritten("t", {"no date": "asked"}).alias("rewritten"), tx.row_key("t", "x").alias("key"))


@query(" UNION ALL ".join(wanted(raw=r, fixed=f, typed=t, project=p) for r, f, t, p in (("%EA%B3%B5+a%3F{id}.pdf", "공+a_{id}.pdf", "%EA%B3%B5+a%3F{id}.pdf", "%EA%B3%B5+a%3F{id}.pdf"), ("a/b  c{id}", "b c{id}.bin", "a/b  c{id}.jpg", "a/b  c{id}"), ("x{id}.do", "x{id}.do", "x{id}.jpg", "x{id}.do"))))
def file_names(spark, d) -> DataFrame:
    """File names repaired, completed by type, and cut to the project."""
    df = table(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.expr(filled(r)) for r in ("%EA%B3%B5+a%3F{id}.pdf", "a/b  c{id}", "x{id}.do")])).alias("raw"))
    return df.select("doc_id", "raw", tx.fixed_name("raw").alias("fixed"), tx.with_ending("raw", F.lit("image/jpeg; q=1")).alias("typed"), tx.path_in_project("raw", "data").alias("project"))


@query(wanted(text="T{id}\nx{k}", passage="passage: T{id}\nx{k}", question="query: T{id}\nx{k}", plain="T{id}\nx{k}", day="{y}-{mm}-02", before="=strftime(CAST(" + filled("{y}-{mm}-02") + " AS DATE) - INTERVAL 180 DAY, '%Y-%m-%d')"))
def embedding_inputs(spark, d) -> DataFrame:
    """Texts for encoders, and the day in another zone."""
    df = _rows(spark, d, a=" T{id} ", c="x{k} and more", at="{y}-{mm}-01 16:00:00").withColumn("t", tx.embedding_text("a", F.lit(None).cast("string"), F.left("c", F.lit(2))))
    day = urls.today_in("Asia/Seoul", F.col("at").cast("timestamp"))
    return df.select("doc_id", F.col("t").alias("text"), tx.prefixed("t", "e5-base", "passage").alias("passage"), tx.prefixed("t", "E5", "query").alias("question"), tx.prefixed("t", "bge", "query").alias("plain"), F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(urls.months_ago(day, 6), "yyyy-MM-dd").alias("before"))


@query(wanted(base="Guide{id}", same="=doc_id % 2 = 0", header="title: Guide{id}.pdf_chunk{k}\n\nbody {m}", title="x{m}", redacted="mail [이메일 확인: 원문 참조]!", html="a{id} b"))
def document_names(spark, d) -> DataFrame:
    """Names of documents, headers of chunks, fenced answers, redacted and plain texts."""
    df = _rows(spark, d, a="Guide{id}.pdf_chunk{k}", b=_cases(x="Guide{id}.pdf_chunk1", y="Guide{next}.pdf_chunk1"), body="body {m}", j='```json\n{"title": "x{m}"}\n```', m="mail a{id}.b@c.org!", h="<p>a{id}<script>no</script></p>\n<b>b</b>")
    return df.select("doc_id", tx.base_document_name("a").alias("base"), tx.same_document("a", "b").alias("same"), chunking.with_header(F.col("body"), {"title": F.col("a")}).alias("header"), tx.parse_fenced_json("j", "title string")["title"].alias("title"), tx.redact_emails("m").alias("redacted"), tx.html_to_text("h").alias("html"))


_QUESTIONS = [
    ("셔틀버스 시간", "bus", "교통/셔틀버스", None, 0.6, "버스", "", ""), ("수강신청 언제", "schedule", "학사일정", "COURSE", 0.65, "", "학사일정", ""), ("오늘 학식", "menu", "식단", None, 0.7, "", "", "http://h/restaurant01.do"), ("장학 안내", "scholarship", "장학", "SCHOLARSHIP", 0.6, "", "장학 소식", ""),
    ("기숙사 입사", "dorm", "생활관/기숙사", "DORM", 0.6, "생활관", "", ""), ("현장실습 인턴", "employment", "취업/채용", "EMPLOYMENT", 0.6, "", "취업", ""), ("축제 행사", "event", "행사/특강", "EVENT", 0.55, "", "비교과", ""), ("안녕 반가워", "chitchat", "인사/잡담", None, 0.5, "", "", ""),
]


def _by(*values) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return "CASE " + " ".join(f"WHEN doc_id % {len(values)} = {k} THEN {show(v)}" for k, v in enumerate(values)) + " END"


_Q = list(zip(*_QUESTIONS, strict=True))


@query(f"SELECT doc_id, {_by(*_Q[1])} AS intent, {_by(*_Q[2])} AS keyword, {_by(*_Q[3])} AS alert, doc_id % 3 = 0 AS refuses, CAST({_by(*_Q[4])} AS DOUBLE) AS boosted, CASE WHEN doc_id % 8 = 0 THEN 'bus' END AS site FROM documents")
def korean_intents(spark, d) -> DataFrame:
    """Intents, keywords, alerts, refusals, the rules' bonuses and routes of Korean questions, one for each document."""
    df = _rows(spark, d, text=f"={_by(*_Q[0])}", site=f"={_by(*_Q[5])}", board_name=f"={_by(*_Q[6])}", url=f"={_by(*_Q[7])}", said=_cases(a="죄송하지만 문서에 없습니다 {m}", b="있습니다 {m}", c="{m}"))
    df = df.withColumns({"title": F.lit(""), "source_type": F.lit("board"), "intent": intents.classify(F.col("text"))})
    rules = spark.createDataFrame([(n, k, a, x) for n, k, a, x in intents.ROUTES], "name string, site_key string, keywords_any array<string>, exclude_keywords_any array<string>")
    routed = tables.route(df.select(F.col("doc_id").alias("id"), "text"), rules).select(F.col("id").alias("doc_id"), "site_key")
    out = df.select("doc_id", "intent", intents.shown_keyword(F.col("text"), F.col("intent")).alias("keyword"), intents.alert(F.col("text")).alias("alert"), intents.refuses(F.col("said")).alias("refuses"), F.round(intents.boost(F.lit(0.5), F.col("intent")), 6).alias("boosted"))
    return out.join(routed, "doc_id", "left").withColumnRenamed("site_key", "site")


_ERRORS = " OR ".join("contains(lower(text), '" + e.lower().replace("'", "''") + "')" for e in pages.ERRORS)


@query(
    f"""SELECT doc_id, CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 500000 THEN 'too_long' WHEN len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) < 20 THEN 'few_words' WHEN {_ERRORS} THEN 'error_page'
WHEN length(trim(title)) < 2 THEN 'no_title' WHEN length(replace(replace(text, ' ', ''), chr(10), '')) < 50 THEN 'white_space' ELSE 'OK' END AS reason, doc_id % 2 = 0 AS login, doc_id % 3 = 0 AS icon, doc_id % 5 >= 1 AS recent
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' Access Denied ' WHEN doc_id % 10 = 4 THEN repeat('a ', 30) || repeat(' ', 80) WHEN doc_id % 10 = 5 THEN left(text, 60) ELSE text END AS text, CASE WHEN doc_id % 10 = 6 THEN ' T' ELSE source || '..' END AS title FROM documents)"""
)
def page_gates(spark, d) -> DataFrame:
    """Every document's first reason to be left out, login pages, icons and old dates."""
    text = "=CASE WHEN doc_id % 10 = 3 THEN concat(text, ' Access Denied ') WHEN doc_id % 10 = 4 THEN concat(repeat('a ', 30), repeat(' ', 80)) WHEN doc_id % 10 = 5 THEN left(text, 60) ELSE text END"
    df = _rows(spark, d, text=text, title="=CASE WHEN doc_id % 10 = 6 THEN ' T' ELSE concat(source, '..') END", url=_cases(a="http://h/Login.do", b="http://h/{id}"), html="<p>{m}", src=_cases(a="/img/logo.png", b="/a{id}x.png", c="/b{id}x"), at="{y}-{mm}-{dd}")
    return df.select("doc_id", pages.quality_reason(F.col("text"), F.col("title")).alias("reason"), pages.is_login(F.col("url"), F.col("html")).alias("login"), pages.is_icon(F.col("src")).alias("icon"), pages.recent(F.col("at"), "2021-01-01").alias("recent"))


@query(
    f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 500000 THEN 'too_long' WHEN len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) < 20 THEN 'few_words' WHEN {_ERRORS} THEN 'error_page'
WHEN length(trim(source)) < 2 THEN 'no_title' WHEN length(replace(replace(text, ' ', ''), chr(10), '')) < 50 THEN 'white_space' ELSE 'OK' END AS reason FROM documents) GROUP BY 1 UNION ALL SELECT 'written', count(*) FROM documents"""
)
def run_counters(spark, d) -> DataFrame:
    """How many documents a run left out for each reason, counted by the pass that wrote them."""
    out = table(spark, d, "documents").withColumn("reason", pages.quality_reason(F.col("text"), F.col("source")))
    reasons = ("too_short", "too_long", "few_words", "error_page", "no_title", "white_space", "OK")
    got = writers.counted(out, new_path(spark, "counted"), {"written": F.count("*"), **{r: F.count_if(F.col("reason") == r) for r in reasons}})
    return spark.createDataFrame([(k, n) for k, n in got.items() if n], "reason string, n long")
