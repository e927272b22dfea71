"""Ground truths, evaluation and reports over given tables: hits are dense search over ``embeddings``, the corpus is ``documents`` with
names made of their ids, truths are ``labels``, ``benchmark`` or what documents hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import containment, evaluation, retrieval
from lectern.plans import query
from lectern.plans.search import _DENSE
from lectern.sources.readers import table
from lectern.sources.shared import staged

# the tables, in SQL and in Spark ------------------------------------------------------------------------------------------

_CORPUS = """corpus AS (SELECT doc_id, 'Guide' || doc_id // 3 || CASE WHEN doc_id % 4 = 0 THEN '.xlsx' ELSE '.pdf' END || CASE WHEN doc_id % 3 > 0 THEN '_chunk' || doc_id % 3 ELSE '' END AS document_name, 'T' || doc_id // 2 AS title FROM documents)"""
_TRUTH = """truth AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 THEN 'Guide' || doc_id // 3 || '.pdf' ELSE 'T' || doc_id // 2 END AS document_name, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS rank FROM labels)"""
_HITS = f"{_DENSE}, {_CORPUS}, hits AS (SELECT query_id, d.doc_id, score, rank::INT AS rank, document_name AS title FROM dense d JOIN corpus USING (doc_id) WHERE rank <= 10)"
#: What search should have found: of each question the documents whose id leaves the same rest by 7.
_NEAR = "near AS (SELECT DISTINCT query_id, doc_id FROM dense WHERE rank <= 20 AND doc_id % 7 = query_id % 7)"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _part(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n).cast("string")


def _corpus(spark, d) -> DataFrame:
    i = F.col("doc_id")
    name = _text("Guide", _part("doc_id", 3), F.when(i % 4 == 0, ".xlsx").otherwise(".pdf"), F.when(i % 3 > 0, _text("_chunk", (i % 3).cast("string"))).otherwise(""))
    return table(spark, d, "documents").select("doc_id", name.alias("document_name"), _text("T", _part("doc_id", 2)).alias("title"))


def _truth(spark, d) -> DataFrame:
    name = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("quality") == 1, _text("Guide", _part("doc_id", 3), ".pdf")).otherwise(_text("T", _part("doc_id", 2)))
    return table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), name.alias("document_name"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("rank"))


def _dense(spark, d, k: int = 10) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return staged(retrieval.dense(v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), v, k), "hits")


def _hits(spark, d) -> DataFrame:
    return _dense(spark, d).join(_corpus(spark, d).select("doc_id", F.col("document_name").alias("title")), "doc_id")


def _near(hits: DataFrame) -> DataFrame:
    return hits.filter("rank <= 20 and doc_id % 7 = query_id % 7").select("query_id", "doc_id")


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.md5("text").alias("query"))


# truths by name -------------------------------------------------------------------------------------------------------------

_BASE = r"trim(regexp_replace(regexp_replace({c}, '_chunk\d*$', ''), '\.(pdf|xlsx|docx)', '', 'g'))"


@query(
    f"""WITH {_CORPUS}, {_TRUTH}, named AS (SELECT query_id, document_name, {_BASE.format(c="document_name")} AS base FROM truth WHERE document_name IS NOT NULL AND rank > 0), based AS (SELECT *, {_BASE.format(c="document_name")} AS base FROM corpus)
SELECT query_id, doc_id FROM named JOIN based USING (base) UNION SELECT query_id, doc_id FROM named n JOIN corpus c ON c.title = n.document_name WHERE n.base NOT IN (SELECT base FROM based)"""
)
def matched_truth(spark, d) -> DataFrame:
    """Documents that a truth names, by plain name or else by title."""
    return evaluation.matched_truth(_truth(spark, d), _corpus(spark, d))


@query(f"""WITH {_CORPUS}, {_TRUTH} SELECT DISTINCT query_id, doc_id FROM truth t JOIN corpus c ON contains(c.document_name, t.document_name) OR starts_with(c.document_name, replace(t.document_name, '.pdf', ''))""")
def contained_truth(spark, d) -> DataFrame:
    """Documents whose name holds the named one, or begins with it."""
    return evaluation.contained_truth(_truth(spark, d), _corpus(spark, d))


_PLAIN = r"trim(regexp_replace(regexp_replace({c}, '_chunk[^_]*$', ''), '\.(pdf|xlsx|docx)', '', 'g'))"
#: Truths that hits can meet: a question's own document and the one after it.
_OWN = "own AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 40 = 0 THEN 'Guide' || doc_id // 3 || '.pdf' ELSE 'uide' || (doc_id + 1) // 30 END AS document_name FROM documents WHERE doc_id % 20 = 0)"
_FOUND = f"met AS (SELECT o.query_id, min(rank) AS first FROM own o JOIN hits h ON h.query_id = o.query_id AND h.rank <= {{k}} AND (contains({_PLAIN.format(c='h.title')}, {_PLAIN.format(c='o.document_name')}) OR contains({_PLAIN.format(c='o.document_name')}, {_PLAIN.format(c='h.title')})) GROUP BY 1)"


def _own(spark, d) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 40 == 0, _text("Guide", _part("doc_id", 3), ".pdf")).otherwise(_text("uide", F.floor((i + 1) / 30).cast("string")))
    return table(spark, d, "documents").filter("doc_id % 20 = 0").select(i.alias("query_id"), name.alias("document_name"))


@query(f"""WITH {_HITS}, {_OWN}, {_FOUND.format(k=5)} SELECT query_id, first FROM (SELECT DISTINCT query_id FROM own) LEFT JOIN met USING (query_id)""")
def names_found(spark, d) -> DataFrame:
    """Ranks of hits whose names hold the named one or are held by it."""
    return evaluation.found_names(_hits(spark, d), _own(spark, d), 5)


_MODELS = f"""WITH {_HITS}, {_OWN}, m AS (SELECT * FROM (VALUES ('a', 10), ('b', 1), ('c', 3)) AS t(model, deepest)),
met AS (SELECT model, o.query_id, min(rank) AS first FROM m, own o JOIN hits h ON h.query_id = o.query_id WHERE rank <= deepest AND (model <> 'c' OR rank > 1) AND (contains({_PLAIN.format(c="h.title")}, {_PLAIN.format(c="o.document_name")}) OR contains({_PLAIN.format(c="o.document_name")}, {_PLAIN.format(c="h.title")})) GROUP BY ALL),
found AS (SELECT model, query_id, first FROM m CROSS JOIN (SELECT DISTINCT query_id FROM own) q LEFT JOIN met USING (model, query_id)),
by_model AS (SELECT model, avg((first IS NOT NULL)::INT) AS recall, avg(first) AS mean_rank FROM found GROUP BY 1),
gap AS (SELECT *, CASE WHEN model = 'a' THEN recall - (SELECT avg(recall) FROM by_model WHERE model <> 'a') END AS bias FROM by_model)"""


@query(f"""{_MODELS} SELECT model, round(recall, 6) AS recall, round(mean_rank, 6) AS mean_rank, round(bias, 6) AS bias, CASE WHEN bias > 0.3 THEN 'strong' WHEN bias > 0.1 THEN 'slight' WHEN bias IS NOT NULL THEN 'none' END AS verdict FROM gap""")
def truth_bias(spark, d) -> DataFrame:
    """How far a truth favours the model that made it: three searches, of which one made it."""
    hits, own = staged(_hits(spark, d), "named-hits"), _own(spark, d)
    models = [("a", hits.filter("rank <= 10")), ("b", hits.filter("rank <= 1")), ("c", hits.filter("rank between 2 and 3"))]
    found = None
    for model, h in models:
        part = evaluation.found_names(h, own, 10).select(F.lit(model).alias("model"), "query_id", "first")
        found = part if found is None else found.unionByName(part)
    return evaluation.bias(found, "a").select("model", *[F.round(c, 6).alias(c) for c in ("recall", "mean_rank", "bias")], "verdict")


# truths by id ---------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_DENSE}, {_NEAR}, h AS (SELECT d.query_id, d.doc_id, d.rank, (n.doc_id IS NOT NULL)::INT AS rel FROM dense d LEFT JOIN near n ON n.query_id = d.query_id AND n.doc_id = d.doc_id WHERE d.rank <= 10),
w AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h), g AS (SELECT query_id, sum(rel) AS n, sum(CASE WHEN rel = 1 THEN seen / rank END) AS p FROM w GROUP BY 1), a AS (SELECT query_id, count(*) AS total FROM near GROUP BY 1)
SELECT query_id, round(coalesce(p / n, 0), 6) AS precision, round(coalesce(n, 0) / total, 6) AS recall FROM a LEFT JOIN g USING (query_id)"""
)
def context_scores(spark, d) -> DataFrame:
    """Precision and recall of contexts by ids."""
    deep = _dense(spark, d, 20)
    out = evaluation.context_scores(deep.filter("rank <= 10"), _near(deep))
    return out.select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_DENSE} SELECT md5(text) AS query, h.doc_id, round(score, 6) AS score FROM dense h JOIN documents q ON q.doc_id = h.query_id WHERE rank = 1""")
def generated_truth(spark, d) -> DataFrame:
    """The best hit of each question as its truth."""
    return evaluation.generated_truth(_dense(spark, d), _questions(spark, d)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_DENSE}, {_NEAR}, judged AS (SELECT doc_id AS query_id, md5(text) AS query FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id)))
SELECT query_id, query FROM judged WHERE query_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) AND query_id NOT IN (SELECT query_id FROM dense JOIN near USING (query_id, doc_id) WHERE rank BETWEEN 2 AND 5) ORDER BY query_id LIMIT 10"""
)
def failed_queries(spark, d) -> DataFrame:
    """The first ten judged questions that no hit but the first answers."""
    deep, asked = _dense(spark, d, 20), _questions(spark, d)
    judged = evaluation.judged_queries(asked, asked.join(table(spark, d, "labels").select(F.col("doc_id").alias("query_id")), "query_id"))
    judged = judged.join(deep.select("query_id").distinct(), "query_id", "left_semi")
    return evaluation.not_found(judged, deep.filter("rank between 2 and 5"), _near(deep))


@query(f"""WITH {_DENSE}, {_NEAR}, r AS (SELECT query_id, min(rank) AS f FROM near JOIN dense USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1), b AS (SELECT DISTINCT query_id FROM near),
t AS (SELECT query_id, min(new) AS f FROM near JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 7, rank) AS new FROM dense WHERE rank <= 10) USING (query_id, doc_id) GROUP BY 1),
e AS (SELECT avg((coalesce(t.f, 99) <= 1)::INT) - avg((coalesce(r.f, 99) <= 1)::INT) AS a, avg((coalesce(t.f, 99) <= 5)::INT) - avg((coalesce(r.f, 99) <= 5)::INT) AS c, avg(coalesce(1 / t.f, 0)) - avg(coalesce(1 / r.f, 0)) AS m FROM b LEFT JOIN r USING (query_id) LEFT JOIN t USING (query_id))
SELECT round(a, 6) AS recall_1_gain, round(c, 6) AS recall_5_gain, round(m, 6) AS mrr_gain FROM e""")
def rerank_gains(spark, d) -> DataFrame:
    """What a second ranking, by the rest of the id, gains over the first."""
    deep = _dense(spark, d, 20)
    before = deep.filter("rank <= 10")
    after = retrieval.top_k(before.withColumnRenamed("rank", "former").withColumn("s", -(F.col("doc_id") % 7).cast("double")), 10, score="s", tie="former")
    out = evaluation.gains(before, after, _near(deep))
    return out.select(*[F.round(c, 6).alias(c) for c in ("recall_1_gain", "recall_5_gain", "mrr_gain")])


# titles and documents ---------------------------------------------------------------------------------------------------------

_TITLES = f"""WITH {_DENSE}, hits AS (SELECT query_id, doc_id, rank, source AS title FROM dense JOIN documents USING (doc_id) WHERE rank <= 10),
once AS (SELECT query_id, title, min(rank) AS rank FROM hits GROUP BY 1, 2), best AS (SELECT query_id, string_agg(title, ',' ORDER BY rank) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM once) WHERE r <= 3 GROUP BY 1)"""


@query(f"""{_TITLES} SELECT query_id, count(*) AS n, count(DISTINCT title) AS titles, any_value(best) AS best FROM hits JOIN best USING (query_id) GROUP BY 1""")
def title_diversity(spark, d) -> DataFrame:
    """Different titles (sources of documents) among the hits, and the three best titles of each question."""
    hits = staged(_dense(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("source").alias("title")), "doc_id"), "titled-hits")
    one = evaluation.unlike_titles(hits, 3)
    names = one.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda r: r["title"]), ",").alias("best"))
    return evaluation.repeated_titles(hits).join(names, "query_id")


@query(
    f"""WITH {_DENSE}, named AS (SELECT doc_id, 'N' || doc_id // 4 AS name FROM documents), a AS (SELECT query_id, c.doc_id, rank FROM dense h JOIN named n ON n.doc_id = h.doc_id JOIN named c ON c.name = n.name WHERE rank <= 5),
b AS (SELECT query_id, doc_id, rank - 5 AS rank FROM dense WHERE rank BETWEEN 6 AND 15), f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5"""
)
def fused_by_document(spark, d) -> DataFrame:
    """Rank fusion in which a dense hit counts for all chunks of its document."""
    deep = _dense(spark, d, 15)
    corpus = table(spark, d, "documents").select("doc_id", _text("N", _part("doc_id", 4)).alias("document_name"))
    later = deep.filter("rank > 5").withColumn("rank", F.col("rank") - 5)
    out = evaluation.fused_by_document(deep.filter("rank <= 5"), later, corpus, 100_000).withColumn("score", F.round("score", 9)).drop("rank")
    return retrieval.top_k(out, 5)


# reports ----------------------------------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT lang AS model, avg((doc_id % 3 = 0)::INT) AS recall_1, avg((doc_id % 3 < 2)::INT) AS recall_5, avg(1 / (1 + doc_id % 4)) AS mrr, count(*)::DOUBLE AS speed, max(length(text))::DOUBLE AS memory, stddev_pop(n_chars) AS spread FROM documents GROUP BY 1), t AS (SELECT max(speed) AS s, max(memory) AS mm, max(spread) AS q FROM m),
w AS (SELECT model, (recall_1 * 0.3 + recall_5 * 0.5 + mrr * 0.2) * 40 AS retrieval, speed / s * 30 AS speed, (1 - memory / mm) * 20 AS memory, spread / q * 10 AS quality FROM m, t)
SELECT model, round(retrieval, 6) AS retrieval, round(speed, 6) AS speed, round(memory, 6) AS memory, round(quality, 6) AS quality, round(retrieval + speed + memory + quality, 6) AS total FROM w"""
)
def weighted_models(spark, d) -> DataFrame:
    """Languages of documents weighed like models: rates, sizes and spread of each."""
    i = F.col("doc_id")
    m = table(spark, d, "documents").groupBy(F.col("lang").alias("model")).agg(
        F.avg((i % 3 == 0).cast("int")).alias("recall_1"), F.avg((i % 3 < 2).cast("int")).alias("recall_5"), F.avg(1 / (1 + i % 4)).alias("mrr"),
        F.count("*").cast("double").alias("speed"), F.max(F.length("text")).cast("double").alias("memory"), F.stddev_pop("n_chars").alias("spread"),
    )
    return evaluation.weighted_models(m).select("model", *[F.round(c, 6).alias(c) for c in ("retrieval", "speed", "memory", "quality", "total")])


@query(
    """WITH r AS (SELECT doc_id AS query_id, 1 + 4 * quality AS accuracy, 1 + doc_id % 5 AS relevance, 5 - 2 * toxic AS completeness, 1 + doc_id % 3 AS groundedness FROM labels), o AS (SELECT *, round((accuracy + relevance + completeness + groundedness) / 4, 2) AS overall FROM r)
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(relevance), 6) AS relevance, round(avg(completeness), 6) AS completeness, round(avg(groundedness), 6) AS groundedness, round(avg(overall), 6) AS overall, arg_max(query_id, {'o': overall, 'q': -query_id}) AS best, arg_min(query_id, {'o': overall, 'q': query_id}) AS worst FROM o"""
)
def judged_answers(spark, d) -> DataFrame:
    """Means of a judge's marks, best and worst answer."""
    i = F.col("doc_id")
    r = table(spark, d, "labels").select(i.alias("query_id"), (1 + 4 * F.col("quality")).alias("accuracy"), (1 + i % 5).alias("relevance"), (5 - 2 * F.col("toxic")).alias("completeness"), (1 + i % 3).alias("groundedness"))
    return evaluation.judged(r).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "relevance", "completeness", "groundedness", "overall")], "best", "worst")


@query("SELECT CASE WHEN contains(d.text, b.text) THEN 'held' END AS how, b.item_id AS query_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY ALL")
def items_in_documents(spark, d) -> DataFrame:
    """In how many documents each benchmark item stands."""
    hit = containment.holding(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("name")))
    return hit.groupBy("query_id").agg(F.count("*").alias("n")).select(F.lit("held").alias("how"), "query_id", "n")
