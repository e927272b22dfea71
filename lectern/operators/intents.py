"""Intent rules: classification, additive boosts, response keywords, alerts, refusals. Rules are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.retrieval import top_k
from lectern.operators.tables import first_rule

#: Keywords of each intent, in the order in which they are tried.
INTENTS = [
    ("chitchat", ["안녕", "하이", "헬로", "hi", "hello", "반가워", "방가", "안녕하세요", "고마워", "감사", "thank", "땡큐", "ㄱㅅ", "ㄳ", "잘가", "바이", "bye", "빠이", "뿅", "종료", "어떻게 지내", "뭐해", "심심", "재밌", "하하", "ㅋㅋ", "ㅎㅎ", "이름이 뭐", "누구", "넌 뭐", "자기소개"]),
    ("bus", ["통학버스", "대구통학버스", "셔틀버스", "버스", "노선", "탑승", "예약", "노쇼"]),
    ("schedule", ["학사일정", "수강꾸러미", "꾸러미", "수강신청", "신청기간", "등록기간", "등록금", "휴학", "복학", "계절학기", "동계", "하계", "개강", "종강"]),
    ("menu", ["식당", "메뉴", "학식", "밥", "점심", "저녁", "오름관", "푸름관", "분식당", "식단", "오늘의 메뉴"]),
    ("scholarship", ["장학", "장학금", "국가장학금", "근로장학", "성적장학", "수혜"]),
    ("dorm", ["생활관", "기숙사", "오름관", "푸름관", "입사", "퇴사", "관생", "선발"]),
    ("employment", ["취업", "채용", "인턴", "일자리", "현장실습", "LINC", "진로", "구인"]),
    ("event", ["행사", "특강", "축제", "세미나", "공모전", "대회", "봉사", "OT", "오티"]),
]
#: What an intent adds to a score, as (intent, [(field, contained text)], bonus).
BOOSTS = [
    ("bus", [("site", "버스"), ("board_name", "버스")], 0.1),
    ("schedule", [("board_name", "학사일정"), ("title", "학사일정")], 0.15),
    ("schedule", [("source_type", "schedule")], 0.2),
    ("menu", [("site", "식당"), ("title", "메뉴"), ("url", "restaurant")], 0.2),
    ("scholarship", [("board_name", "장학"), ("board_name", "학생복지")], 0.1),
    ("dorm", [("site", "생활관"), ("board_name", "기숙사")], 0.1),
    ("employment", [("board_name", "취업"), ("board_name", "채용"), ("board_name", "현장실습")], 0.1),
    ("event", [("board_name", "행사"), ("board_name", "비교과")], 0.05),
]
#: The keyword shown for an intent, alert categories of titles, and phrases of an answer that found nothing.
KEYWORDS = {"bus": "교통/셔틀버스", "schedule": "학사일정", "menu": "식단", "scholarship": "장학", "dorm": "생활관/기숙사", "employment": "취업/채용", "event": "행사/특강", "chitchat": "인사/잡담"}
ALERTS = [("SCHOLARSHIP", ["장학"]), ("COURSE", ["학사", "수강"]), ("DORM", ["생활관", "기숙사"]), ("EVENT", ["행사", "특강"]), ("EMPLOYMENT", ["취업", "인턴", "채용"])]
REFUSALS = ["죄송하지만", "찾을 수 없습니다", "정보가 없습니다", "문서에 없습니다", "도와드릴 수 없어요", "제공할 수 없어요", "정보를 찾을 수 없어요"]
ROUTES = [("대구통학버스", "bus", ["통학버스", "대구통학버스", "셔틀버스", "통학 버스"], ["수강꾸러미", "학사일정"]), ("www", "main", ["수강꾸러미", "학사일정", "등록금", "휴학", "복학", "계절수업"], ["통학버스", "셔틀버스"])]


def classify(text: Column, intents=None) -> Column:
    return first_rule(F.btrim(text), intents or INTENTS, "general")


def alert(title: Column) -> Column:
    return first_rule(title, ALERTS, F.lit(None).cast("string"))


def refuses(answer: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in REFUSALS]), lambda x: F.contains(answer, x))


def shown_keyword(text: Column, intent: Column, fallback=None) -> Column:
    """The intent's keyword, or else ``fallback`` (a function of the query), or the first ten characters."""
    names = F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, intent), fallback(text) if fallback else F.left(text, F.lit(10)))


def boost(score: Column, intent: Column, boosts=None) -> Column:
    """``score`` with the bonuses of the intent; fields are columns of the row, null ones are empty."""
    for name, tests, bonus in boosts or BOOSTS:
        hit = F.lit(False)
        for field, part in tests:
            hit = hit | F.contains(F.coalesce(F.col(field), F.lit("")), F.lit(part))
        score = score + F.when((intent == name) & hit, bonus).otherwise(0.0)
    return score


def rerank_with_boost(hits: DataFrame, k: int, boosts=None, digits: int | None = None) -> DataFrame:
    """The k best by boosted score for each query; the plain score stays, ties keep the former rank."""
    score = boost(F.col("score"), F.col("intent"), boosts)
    df = hits.withColumn("boosted", score if digits is None else F.round(score, digits))
    return top_k(df.withColumnRenamed("rank", "former"), k, "boosted", tie="former").drop("former")
