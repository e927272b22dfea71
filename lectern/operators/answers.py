"""The answer step for tables of questions: intent, retrieval, threshold, context, answer, sources, dates.

Everything up to the model's answer is one plan; the model is a function of columns (system and user message) that the caller
gives, as are search and reranking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import intents, retrieval
from lectern.operators.tables import keep_first

#: The answer where nothing is near enough, and the frame of a question to the model.
NOTHING = "죄송합니다. 학교 정보와 관련이 없거나, 해당 내용을 문서에서 찾을 수 없습니다."
QUESTION, BEGIN, END, TASK = "질문: ", "--- 검색된 문서 시작 ---", "--- 검색된 문서 끝 ---", "위 문서를 정밀하게 분석하여 질문에 답변해줘."
THRESHOLD, SOURCE_CHARS = 0.4, 1024

Model = Callable[[Column, Column], Column]


def system_message(today: Column) -> Column:
    """What the model is told: the date, to answer from the documents only, and to say so where they hold nothing."""
    day, year = F.date_format(today, "yyyy-MM-dd"), F.year(today).cast("string")
    return F.concat(F.lit("Today is "), day, F.lit(". Answer only from the documents found; if they do not hold the answer, say so. Check whether they are of "), year, F.lit(" and say which year they are of if not."))


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context): texts by rank with where they come from, blank ones left out but counted. At most k a query."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] site="), known("site"), F.lit(" | board="), known("board_name"), F.lit(" | title="), known("title"), F.lit(" | date="), known("created_at"), F.lit(" | url="), known("url"))
    rows = hits.filter(tx.trim("text") != "").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(head, F.lit("\n"), "text").alias("b")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n---\n\n").alias("context"))


def answer(queries: DataFrame, search: Callable[[DataFrame], DataFrame], documents: DataFrame, model: Model, today: Column, threshold: float = THRESHOLD, extract: Callable[[Column], Column] = tx.schedule_dates) -> DataFrame:
    """Per question (query_id, query): intent, answer, sources (title, url, text), schedule (title, start, end).

    Small talk goes to the model without a search. ``search`` gives (query_id, doc_id, score, rank), at most k a question; none of
    them counts where the best score is below ``threshold``. An answer that found nothing has no sources; dates are taken from
    answers with sources to questions about the schedule, or that name a year."""
    asked = queries.select("query_id", "query", intents.classify(F.col("query")).alias("intent"))
    hits = retrieval.drop_below(search(asked.filter("intent <> 'chitchat'")), threshold).join(documents, "doc_id")
    sources = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url", "text"))).alias("s"))
    met = asked.join(context_blocks(hits), "query_id", "left").join(sources, "query_id", "left")
    user = F.concat(F.lit(QUESTION), "query", F.lit(f"\n\n{BEGIN}\n"), F.coalesce("context", F.lit("")), F.lit(f"\n{END}\n\n{TASK}"))
    said = F.when(F.col("intent") == "chitchat", model(system_message(today), F.col("query"))).when(F.col("s").isNull(), F.lit(NOTHING)).otherwise(model(system_message(today), user))
    met = met.withColumn("answer", tx.finished_answer(said))
    shown = F.when(F.col("s").isNull() | intents.refuses(F.col("answer")), F.array().cast("array<struct<title:string,url:string,text:string>>")).otherwise(F.transform("s", lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["text"].alias("text"))))
    met = met.withColumn("sources", shown)
    dated = (F.size("sources") > 0) & ((F.col("intent") == "schedule") | F.contains("answer", F.lit("202")))
    found = extract(F.col("answer"))
    return met.select("query_id", "query", "intent", "context", "answer", "sources", F.when(dated & found["start"].isNotNull(), found).alias("schedule"))


def shown_sources(answers: DataFrame) -> DataFrame:
    """(query_id, title, url, rank): sources for display, each title once with its first address."""
    rows = answers.select("query_id", F.posexplode("sources").alias("rank", "s")).select("query_id", "rank", "s.title", "s.url")
    return keep_first(rows, ["query_id", "title"], ["rank"])


def reranked_search(dense: DataFrame, sparse: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 5, alpha: float = 0.85, candidates: int = 30, chars: int = SOURCE_CHARS) -> DataFrame:
    """Fifty of each list fused, thirty of these scored again on the first ``chars`` characters of their text, the k best kept.
    ``texts``: query_id, doc_id, query, text."""
    fused = retrieval.fuse(dense, sparse, alpha, candidates).select("query_id", "doc_id", "rank")
    return retrieval.rerank(fused.join(texts, ["query_id", "doc_id"]), scorer, k, chars)


def response(answers: DataFrame) -> DataFrame:
    """The row that an answer's reader gets: keyword, sources without repeats, and whether there are dates."""
    once = F.transform(F.array_distinct(F.transform("sources", lambda s: s["title"])), lambda t: F.struct(t.alias("title"), F.element_at(F.filter("sources", lambda s: s["title"].eqNullSafe(t)), 1)["url"].alias("url")))
    return answers.select("query_id", "answer", intents.shown_keyword(F.col("query"), F.col("intent")).alias("keyword"), once.alias("sources"), F.col("schedule.start").isNotNull().alias("is_date"), "schedule")


def conversation_turns(messages: DataFrame, last: int = 10) -> DataFrame:
    """(session, history): the last messages of each session in order, as text. State of a conversation is its own rows."""
    newest = Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    few = messages.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last)
    rows = few.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("session", F.array_join(F.transform("m", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").alias("history"))
