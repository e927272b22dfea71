"""Cases by hand: the answer step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hand_pages import query
from lectern.operators import answers
from lectern.plans import rows

# answers ------------------------------------------------------------------------------------------------------------------

_ASKED = [(1, "셔틀버스 시간"), (2, "안녕"), (3, "수강신청 언제"), (4, "도서관"), (5, "모르는 것")]
_FOUND = [(1, 10, 0.9, 1), (1, 11, 0.3, 2), (3, 12, 0.5, 1), (3, 13, 0.45, 2), (4, 10, 0.39, 1), (5, 11, 0.8, 1)]
_TEXTS = [(10, "버스는 9시", "버스", "u10"), (11, " ", "빈", "u11"), (12, "2025-02-10 ~ 2025-02-14", "일정", "u12"), (13, "둘째", "일정", "u13")]


def _model(system, user):
    """A model that answers from what it is told: the first text, or that it found nothing."""
    text = F.regexp_extract(user, r"\[\d+\][^\n]*\n([^\n]*)", 1)
    return F.when(~F.contains(user, F.lit("검색된 문서 시작")), F.concat(F.lit("반가워요: "), user)).when(text == "", F.lit("문서에 없습니다")).otherwise(F.concat(text, F.lit("\\n끝 ")))


def _answers(spark) -> DataFrame:
    found = spark.createDataFrame(_FOUND, "query_id long, doc_id long, score double, rank int")
    texts = spark.createDataFrame(_TEXTS, "doc_id long, text string, title string, url string").withColumns({"site": F.lit("s"), "board_name": F.lit("b"), "created_at": F.lit("2025-01-01")})
    return answers.answer(spark.createDataFrame(_ASKED, "query_id long, query string"), lambda q: found.join(q.select("query_id"), "query_id", "left_semi"), texts, _model, F.lit("2025-02-01").cast("date"))


@query(
    rows(
        "query_id long, intent string, answer string, context string, titles string, start string, last string, keyword string, is_date boolean",
        [
            (1, "bus", "버스는 9시\n끝", "[1] site=s | board=b | title=버스 | date=2025-01-01 | url=u10\n버스는 9시", "버스,빈", None, None, "교통/셔틀버스", False),
            (2, "chitchat", "반가워요: 안녕", None, "", None, None, "인사/잡담", False),
            (3, "schedule", "2025-02-10 ~ 2025-02-14\n끝", "[1] site=s | board=b | title=일정 | date=2025-01-01 | url=u12\n2025-02-10 ~ 2025-02-14\n\n---\n\n[2] site=s | board=b | title=일정 | date=2025-01-01 | url=u13\n둘째", "일정", "2025-02-10", "2025-02-14", "학사일정", True),
            (4, "general", "죄송합니다. 학교 정보와 관련이 없거나, 해당 내용을 문서에서 찾을 수 없습니다.", None, "", None, None, "도서관", False),
            (5, "general", "문서에 없습니다", None, "", None, None, "모르는 것", False),
        ],
    )
)
def answered_questions(spark, d) -> DataFrame:
    """The whole answer step: small talk, threshold, context, refusals, sources once a title, dates."""
    a = _answers(spark)
    r = answers.response(a).select("query_id", "keyword", F.array_join(F.transform("sources", lambda s: s["title"]), ",").alias("titles"), "is_date")
    return a.select("query_id", "intent", "answer", "context", F.col("schedule.start").alias("start"), F.col("schedule.end").alias("last")).join(r, "query_id")


@query(rows("query_id long, title string, url string, rank int", [(1, "버스", "u10", 0), (1, "빈", "u11", 1), (3, "일정", "u12", 0)]))
def shown_sources(spark, d) -> DataFrame:
    """Sources for display, each title once."""
    return answers.shown_sources(_answers(spark))
