"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.vectors import let

#: Navigation and copyright phrases that are no part of a page's text.
CORPUS_NOISE = (
    r"공지사항.*?바로가기", r"다음\s*페이지", r"이전\s*페이지", r"페이지\s*이동", r"목록으로", r"top\s*↑", r"맨\s*위로", r"Home\s*›", r"sitemap",
    r"copyright.*?all\s+rights\s+reserved", r"개인정보처리방침", r"이메일무단수집거부", r"\[\s*인쇄\s*\]", r"\[\s*목록\s*\]", r"\s{3,}",
)
#: Lines that hold a contents heading, a page number or a copyright mark only.
LINE_NOISE = (r"차\s*례$", r"목\s*차$", r"참고문헌$", r"부\s*록$", r"Copyright", r"저작권", r"All Rights Reserved", r"페이지\s*\d+$", r"\d+$", r"-\s*\d+\s*-$")
#: Marks around tables, labels of a post's head, and starts of its tail.
TABLE_MARKS = ("[표 데이터 시작]", "[표 데이터 끝]")
HEAD_LABELS, DATE_LABEL, TAIL_MARKS = ("작성자", "조회", "작성일"), "작성일", ("이전글", "다음글", "목록")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_MARK = "[이메일 확인: 원문 참조]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    return F.nullif(F.btrim(_c(x)), F.lit(""))


def collapse(x) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def clean_corpus(x) -> Column:
    """Noise phrases out (any case), white space collapsed; null is empty."""
    text = F.coalesce(_c(x), F.lit(""))
    return collapse(reduce(lambda t, p: F.regexp_replace(t, f"(?iU){p}", " "), CORPUS_NOISE, text))


def clean_lines(x) -> Column:
    """Noise lines and blank lines out, the rest on one line."""
    noise = "(?iU)^(" + "|".join(LINE_NOISE) + ")"
    lines = F.transform(F.split(F.coalesce(_c(x), F.lit("")), "\n"), lambda s: collapse(s))
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~s.rlike(noise)), " ")


def clean_post(x) -> Column:
    """A board post without its head (up to the date label) and its tail; a short rest of a long text gives the text back."""
    raw = F.coalesce(_c(x), F.lit(""))
    text = reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("")), TABLE_MARKS, raw)
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: F.rtrim(s))
    names = F.transform(lines, lambda s: F.btrim(s))
    at = F.array_position(names, DATE_LABEL).cast("int")
    body = F.when((at > 0) & (at < F.size(lines)), F.slice(lines, at + 1, F.size(lines))).otherwise(lines)
    tail = lambda s: reduce(lambda a, b: a | b, [F.btrim(s).startswith(m) for m in TAIL_MARKS])
    end = F.array_position(F.transform(body, tail), True).cast("int")
    kept = F.filter(F.when(end > 0, F.slice(body, 1, end - 1)).otherwise(body), lambda s: F.btrim(s) != "")
    out = F.array_join(kept, "\n")
    return F.when((F.length(out) < 10) & (F.length(raw) > 50), F.btrim(text, F.lit(" \t\r\n"))).otherwise(out)


def redact_emails(x, mark: str = EMAIL_MARK) -> Column:
    return F.regexp_replace(_c(x), EMAIL, mark)


def html_to_text(x) -> Column:
    """Scripts, styles and tags out, white space collapsed; references stay as they are."""
    text = F.regexp_replace(_c(x), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return collapse(F.regexp_replace(text, r"(?s)<[^>]+>", " "))


def tokens(x) -> Column:
    """Lower-case words, split at white space."""
    plain = F.lower(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)[^\w\s]", " "))
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")


def ngram_tokens(x) -> Column:
    """Words, and the 2-grams and 3-grams of their characters."""
    return with_ngrams(tokens(x))


def with_ngrams(words: Column) -> Column:
    """An array of words with the 2-grams and 3-grams of their characters behind them."""
    grams = lambda t, n: F.flatten(F.transform(F.filter(t, lambda w: F.length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))))
    return let(words, lambda t: F.concat(t, grams(t, 2), grams(t, 3)))


def guess_lang(x) -> Column:
    return F.when(_c(x).rlike("[가-힣]"), "ko").otherwise("en")


def parse_fenced_json(x, schema: str) -> Column:
    """A JSON object out of an answer that may wrap it in a code fence; null fields where it is none."""
    return F.from_json(F.btrim(F.regexp_replace(_c(x), r"```(json)?", "")), schema)


def base_document_name(x) -> Column:
    """A chunk's name without its chunk suffix and file extension."""
    name = F.regexp_replace(_c(x), r"_chunk\d*$", "")
    return F.btrim(F.regexp_replace(name, r"\.(pdf|xlsx|docx)", ""))


def same_document(a, b) -> Column:
    """Whether two names are of one document, whatever their chunk suffixes."""
    plain = lambda x: F.regexp_replace(_c(x), r"_chunk\d+$", "")
    return (_c(a) == _c(b)) | (plain(a) == plain(b))


# older cleaners, schedules, answers -------------------------------------------------------------------------------------

#: Phrases that the older cleaner takes out; phrases of one site are given by the caller.
OLD_NOISE = (
    r"Fetched at:.*?\n", r"본문 바로가기\s*", r"Snapshot of\s*https?://[^\s]+", r"HOME\s*", r"공지사항\s*공지사항\s*공지사항", r"다음페이지\s*", r"이전페이지\s*", r"첫페이지\s*", r"마지막페이지\s*",
    r"페이지\s*이동\s*", r"\[이전글\].*?\n", r"\[다음글\].*?\n", r"목록\s*수정\s*삭제\s*", r"조회\s*\d+\s*날짜\s*\d{4}-\d{2}-\d{2}", r"작성자\s*\S+\s*조회\s*\d+", r"파일첨부\s*", r"인쇄하기\s*",
    r"페이스북\s*", r"트위터\s*", r"카카오스토리\s*", r"네이버밴드\s*", r"URL\s*복사\s*", r"QUICK\s+MENU\s*", r"SITEMAP\s*", r"TOP\s*▲\s*",
)
#: What a page of the schedule is told by, its table's first heading, the columns of its rows, and its tags.
SCHEDULE, FIRST_HEADING, ROW_LINES = "학사일정", "번호", 6
SCHEDULE_TAGS = ("학사일정", "일정표", "주요학사일정", "개강", "종강", "시험기간")
SCHEDULE_HEAD = ("이 문서는 {} 정보입니다.", "주요 일정은 다음과 같습니다.\n")
#: Types of content and the file endings that they stand for.
MIME_ENDINGS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/svg+xml": ".svg", "application/pdf": ".pdf", "application/zip": ".zip", "text/plain": ".txt", "text/html": ".html"}


def text_lines(x) -> Column:
    return F.split(F.coalesce(_c(x), F.lit("")), r"\r\n|\n|\r")


def solid_lines(x) -> Column:
    """Lines without white space around them, none that are blank."""
    return F.filter(F.transform(text_lines(x), lambda s: trim(s)), lambda s: s != "")


def trim(x) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def clean_old(x, extra: tuple[str, ...] = ()) -> Column:
    """Phrases out, runs of three line ends to two and of blanks to one; null stays null."""
    text = reduce(lambda t, p: F.regexp_replace(t, f"(?imU){p}", ""), (*OLD_NOISE, *extra), _c(x))
    return trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "))


def clean_filtered(x) -> Column:
    """Hard blanks and tabs are blanks, runs of them one, three line ends two; then noise phrases out, leaving nothing."""
    text = F.regexp_replace(F.translate(F.coalesce(_c(x), F.lit("")), " \t", "  "), " +", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trim(reduce(lambda t, p: F.regexp_replace(t, f"(?iU){p}", ""), CORPUS_NOISE[:-1], text))


def clean_page_lines(x) -> Column:
    """Runs of blanks are one, lines without white space around them, no blank lines."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), "\n"), lambda s: trim(F.regexp_replace(s, " +", " "))), lambda s: s != ""), "\n")


def after_label(lines: Column, label: str) -> Column:
    """The line behind the last line that is the label alone, if there is one behind it."""
    pairs = lambda t: F.filter(F.transform(t, lambda s, i: F.struct(s.alias("s"), F.get(t, i + 1).alias("v"))), lambda r: (r["s"] == label) & r["v"].isNotNull())
    return F.try_element_at(let(lines, pairs), F.lit(-1))["v"]


def post_header(x) -> Column:
    """Author, views and date as the lines behind their labels."""
    author, date, views = HEAD_LABELS[0], DATE_LABEL, HEAD_LABELS[1]
    number = lambda t: F.nullif(F.regexp_replace(after_label(t, views), r"\D", ""), F.lit("")).try_cast("int")
    return let(solid_lines(x), lambda t: F.struct(after_label(t, author).alias("author"), number(t).alias("view_count"), after_label(t, date).alias("created_at")))


def schedule_lines(x, intro: str) -> Column:
    """Lines with a day and month, each marked, behind ``intro``; a text without such a line stays."""
    lines = F.filter(solid_lines(x), lambda s: s.rlike(r"\d{1,2}[./-]\d{1,2}"))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(F.lit(intro)), F.transform(lines, lambda s: F.concat(F.lit("일정 정보: "), s))), "\n")).otherwise(F.coalesce(_c(x), F.lit("")))


def schedule_sentences(x, url, board, title) -> Column:
    """The rows of a schedule's page as sentences: six lines a row behind the headings (number, title, first day, last day, ...). Of
    other pages, and where no row has a date, the text stays."""
    part = lambda c: F.coalesce(trim(_c(c)), F.lit(""))
    is_schedule = F.contains(part(url), F.lit("schedule")) | F.contains(part(board), F.lit(SCHEDULE)) | F.contains(part(title), F.lit(SCHEDULE))
    told = lambda r: F.concat(F.lit("• "), r[1], F.lit(": "), r[2], F.when(r[2] == r[3], F.lit(" (하루)")).otherwise(F.concat(F.lit(" ~ "), r[3])))

    def sentences(lines: Column, base: Column) -> Column:
        n = F.floor((F.size(lines) - base + 1) / ROW_LINES).cast("int")
        rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(lines, base + i * ROW_LINES, F.lit(ROW_LINES)))
        return F.when((base > ROW_LINES) & (n > 0), F.transform(F.filter(rows, lambda r: F.contains(r[2], F.lit("-"))), told))

    # from 1: the first line of the first row
    found = let(solid_lines(x), lambda t: let(F.array_position(t, FIRST_HEADING).cast("int") + ROW_LINES, lambda base: sentences(t, base)))
    head = F.array(F.replace(F.lit(SCHEDULE_HEAD[0]), F.lit("{}"), part(board)), F.lit(SCHEDULE_HEAD[1]))
    return F.when(is_schedule, let(found, lambda f: F.when(F.size(f) > 0, F.array_join(F.concat(head, f), "\n")).otherwise(_c(x)))).otherwise(_c(x))


def schedule_tags(tags, before, after) -> Column:
    """The tags with those of a schedule behind them, each once, where the text was made into sentences."""
    old = F.coalesce(_c(tags), F.array().cast("array<string>"))
    return F.when(_c(before).eqNullSafe(_c(after)), _c(tags)).otherwise(F.array_distinct(F.concat(old, F.array(*[F.lit(t) for t in SCHEDULE_TAGS]))))


def schedule_dates(answer) -> Column:
    """Title and first two dates of an answer: the first line if it is shorter than 100; dates as they are written, in dashes."""
    dates = F.transform(F.regexp_extract_all(_c(answer), F.lit(r"\d{4}[-년]\s?\d{1,2}[-월]\s?\d{1,2}일?"), 0), lambda d: F.translate(d, "년월일 ", "--"))
    first = trim(F.get(F.split(_c(answer), "\n"), F.lit(0)))
    title = F.when((F.length(first) > 0) & (F.length(first) < 100), first)
    return F.struct(title.alias("title"), F.get(dates, F.lit(0)).alias("start"), F.get(dates, F.lit(1)).alias("end"))


def finished_answer(x) -> Column:
    """Without white space around it; line ends that were written out are line ends."""
    return F.replace(trim(x), F.lit("\\n"), F.lit("\n"))


def rewritten(x, table: dict[str, str]) -> Column:
    """Another text for those that the table has."""
    if not table:
        return _c(x)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), _c(x)), _c(x))


def post_date(x) -> Column:
    """The first date with four, two and two digits, in dashes."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(x), r"(\d{4}[.-]\d{2}[.-]\d{2})", 1), r"\.", "-"), F.lit(""))


def row_key(*xs) -> Column:
    """Texts as one key: lower case, white space as single blanks."""
    return F.regexp_replace(trim(F.lower(F.concat_ws("||", *[_c(x) for x in xs]))), r"(?U)\s+", " ")


def embedding_text(*xs, chars: int = 4000) -> Column:
    """The texts that are not blank, a line each, cut."""
    return F.left(F.array_join(F.filter(F.array(*[F.coalesce(trim(x), F.lit("")) for x in xs]), lambda t: t != ""), "\n"), F.lit(chars))


def prefixed(x, provider: str, kind: str) -> Column:
    """What a provider's encoder wants before a passage or a query."""
    return F.concat(F.lit({"passage": "passage: ", "query": "query: "}[kind]), _c(x)) if provider.lower().startswith("e5") else _c(x)


def path_in_project(x, root: str) -> Column:
    """A path from the project's folder on."""
    return F.coalesce(F.nullif(F.regexp_extract(F.replace(_c(x), F.lit("\\"), F.lit("/")), rf"(?:^|/)({root}/.*)$", 1), F.lit("")), _c(x))


def first_filled(*xs) -> Column:
    """The first text that is not blank; empty if none."""
    return F.coalesce(*[blank_to_null(x) for x in xs], F.lit(""))


def with_ending(name, content_type) -> Column:
    """A file's name with the ending of its type, where it has none or one of a script."""
    ending = F.try_element_at(F.create_map(*[F.lit(v) for kv in MIME_ENDINGS.items() for v in kv]), trim(F.get(F.split(_c(content_type), ";"), F.lit(0))))
    weak = F.lower(_c(name)).endswith(".do") | ~F.contains(_c(name), F.lit("."))
    return F.when(weak & ending.isNotNull(), F.concat(F.regexp_replace(_c(name), r"\.[^.]*$", ""), ending)).otherwise(_c(name))


def fixed_name(x, ending: str = ".bin") -> Column:
    """A file's name out of an escaped or twice encoded one: last part of the path, composed letters, no characters that file
    systems refuse, an ending. In Python: unescaping leaves plus signs alone, and wrong encodings are tried."""
    def one(raw: str | None) -> str | None:
        import os
        import re
        import unicodedata
        from urllib.parse import unquote

        if raw is None:
            return None
        raw = unquote(raw)
        for _ in range(2):
            try:
                raw = raw.encode("latin-1").decode("utf-8")
            except UnicodeError:
                pass
        name = unicodedata.normalize("NFC", os.path.basename(raw).strip())
        name = " ".join(re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", name).split())
        return name if os.path.splitext(name)[1] else name + ending

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(_c(x))
