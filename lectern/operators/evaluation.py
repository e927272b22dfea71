"""Evaluation of retrieval and of runs, as ordinary aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.containment import holding
from lectern.operators.retrieval import top_k
from lectern.operators.tables import keep_first

def first_ranks(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, first): rank of the first relevant hit of each judged query, null if there is none."""
    met = hits.join(truth.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return truth.select("query_id").distinct().join(met, "query_id", "left")


def recall_and_mrr(hits: DataFrame, truth: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Hit rates at each k and the mean reciprocal rank, one row."""
    f = first_ranks(hits, truth)
    return f.agg(F.count("*").alias("queries"), *[F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def ndcg(hits: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, dcg, ndcg): gains 1; ``dcg`` takes the ideal to be 1 (and may exceed it), ``ndcg`` the ideal order."""
    rel = truth.select("query_id", "doc_id").distinct()
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    got = hits.filter(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k).cast("long")).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    out = n.join(got, "query_id", "left").select("query_id", F.coalesce("dcg", F.lit(0.0)).alias("dcg"), ideal.alias("ideal"))
    return out.select("query_id", "dcg", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def score_bands(df: DataFrame, score: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    s = F.col(score)
    return df.agg(F.count_if(s >= 0.7).alias("high"), F.count_if(s >= 0.6).alias("good"), F.count_if(s < 0.5).alias("low"), share(s >= 0.7).alias("high_pct"), share(s >= 0.6).alias("good_pct"), share(s < 0.5).alias("low_pct"))


def compare_variants(df: DataFrame, variant: str, metrics: list[str], baseline: str) -> DataFrame:
    """(variant, metric, mean, improvement, best): NaN is skipped; improvement in % over a baseline above 0."""
    rows = df.select(variant, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v"))
    means = rows.groupBy(variant, "metric").agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("mean"))
    stats = means.groupBy("metric").agg(F.max(F.when(F.col(variant) == baseline, F.col("mean"))).alias("base"), F.max_by(variant, F.struct("mean", variant)).alias("best"))
    gain = F.when(F.col("base") > 0, (F.col("mean") - F.col("base")) / F.col("base") * 100)
    return means.join(stats, "metric").select(variant, "metric", "mean", gain.alias("improvement"), (F.col(variant) == F.col("best")).alias("best"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """(key, n, pct). The total is an aggregate of the counts, not a window over all rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(key, "n", (F.col("n") * 100.0 / F.col("all")).alias("pct"))


def pair_similarity(vectors: DataFrame, n: int = 100) -> DataFrame:
    """Mean, standard deviation of the population, min, max and median of the cosines of all pairs of the first ``n`` vectors."""
    from lectern.functions.vectors import dot, l2_normalize

    v = vectors.orderBy("doc_id").limit(n).select("doc_id", l2_normalize("vector").alias("v"))
    a, b = v.alias("a"), F.broadcast(v).alias("b")
    s = a.join(b, F.col("a.doc_id") < F.col("b.doc_id")).select(dot("a.v", "b.v").alias("s"))
    return s.agg(F.count("*").alias("pairs"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"), F.median("s").alias("median"))


# ground truth -------------------------------------------------------------------------------------------------------------


def matched_truth(truth: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents of the named ones (``truth``: query_id, document_name; ``corpus``: doc_id, document_name, title),
    by their names without chunk suffix and ending, or, where none has the name, by the title. Rows with a rank of 0 or less are
    no truth."""
    named = truth.filter("document_name is not null")
    named = named.filter("rank > 0") if "rank" in truth.columns else named
    base = corpus.select("doc_id", tx.base_document_name("document_name").alias("base")).filter("base <> ''")
    asked = named.select("query_id", "document_name", tx.base_document_name("document_name").alias("base"))
    first = asked.join(base, "base").select("query_id", "doc_id")
    rest = asked.join(base.select("base").distinct(), "base", "left_anti")
    second = rest.join(corpus.select("doc_id", F.col("title").alias("document_name")), "document_name").select("query_id", "doc_id")
    return first.unionByName(second).distinct()


def contained_truth(truth: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose name holds the named one, or begins with it without its ending."""
    asked = truth.select("query_id", F.col("document_name").alias("name"), F.replace("document_name", F.lit(".pdf"), F.lit("")).alias("stem"))
    whole = holding(corpus, asked, text_col="document_name")
    begun = holding(corpus, asked, text_col="document_name", name_col="stem", at_start=True)
    return whole.unionByName(begun).distinct()


def found_names(hits: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, first): rank of the first hit among the k best (query_id, title, rank) whose plain name equals, holds, or is held by
    the named document's; null if none."""
    plain = lambda c: tx.trim(F.regexp_replace(F.regexp_replace(c, r"_chunk[^_]*$", ""), r"\.(pdf|xlsx|docx)", ""))
    t = truth.select("query_id", plain("document_name").alias("gt"))
    met = t.join(hits.filter(F.col("rank") <= k).select("query_id", plain("title").alias("t"), "rank"), "query_id")
    met = met.filter(F.contains("t", F.col("gt")) | F.contains("gt", F.col("t")))
    return truth.select("query_id").distinct().join(met.groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")


def bias(found: DataFrame, own: str, strong: float = 0.3, slight: float = 0.1) -> DataFrame:
    """(model, recall, mean_rank, bias, verdict) of (model, query_id, first): a model's recall less the mean of the others', and what
    that says of a truth that was chosen from ``own``'s hits. One row a model."""
    by = found.groupBy("model").agg(F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.avg("first").alias("mean_rank"))
    others = by.filter(F.col("model") != own).agg(F.avg("recall").alias("others"))
    gap = F.when(F.col("model") == own, F.col("recall") - F.col("others"))
    out = by.crossJoin(F.broadcast(others)).withColumn("bias", gap)  # one row
    return out.select("model", "recall", "mean_rank", "bias", F.when(F.col("bias") > strong, "strong").when(F.col("bias") > slight, "slight").when(F.col("bias").isNotNull(), "none").alias("verdict"))


def generated_truth(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc_id, score): the best hit of each question as its truth. Such a truth favours the search that made it."""
    return hits.filter("rank = 1").join(queries, "query_id").select("query", "doc_id", "score")


def judged_queries(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """Questions that have a truth, by their text."""
    return queries.join(truth.select("query").distinct(), "query", "left_semi")


def with_timings(results: DataFrame, timings: DataFrame, key: str = "variant") -> DataFrame:
    """Results of variants with their timings, where there are any."""
    return results.join(timings, key, "left")


def not_found(queries: DataFrame, hits: DataFrame, truth: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` questions without a relevant hit, by id."""
    good = hits.join(truth.select("query_id", "doc_id"), ["query_id", "doc_id"]).select("query_id")
    return queries.join(good, "query_id", "left_anti").orderBy("query_id").limit(n)


def context_scores(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, precision, recall): by ids, what a judge would say of contexts. Precision is the mean of the precisions at the ranks
    of relevant hits."""
    rel = truth.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    met = hits.select("query_id", "doc_id", "rank").join(rel, ["query_id", "doc_id"], "left").fillna(0, ["rel"])
    w = Window.partitionBy("query_id").orderBy("rank")  # at most k rows a query
    met = met.withColumn("seen", F.sum("rel").over(w))
    got = met.groupBy("query_id").agg(F.sum("rel").alias("n"), F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank"))).alias("p"))
    out = rel.groupBy("query_id").agg(F.count("*").alias("all")).join(got, "query_id", "left")
    return out.select("query_id", F.coalesce(F.col("p") / F.col("n"), F.lit(0.0)).alias("precision"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("recall"))


# reports ------------------------------------------------------------------------------------------------------------------


def weighted_models(models: DataFrame) -> DataFrame:
    """Models by a total of 100: retrieval 40 (recall at 1 and 5 and MRR by 3, 5, 2), speed 30 and memory 20 against the most, spread of
    similarities 10. One row a model."""
    most = models.agg(F.max("speed").alias("s"), F.max("memory").alias("m"), F.max("spread").alias("q"))
    df = models.crossJoin(F.broadcast(most))  # one row
    df = df.select(
        "model", ((F.col("recall_1") * 0.3 + F.col("recall_5") * 0.5 + F.col("mrr") * 0.2) * 40).alias("retrieval"), (F.col("speed") / F.col("s") * 30).alias("speed"),
        ((1 - F.col("memory") / F.col("m")) * 20).alias("memory"), (F.col("spread") / F.col("q") * 10).alias("quality"),
    )
    return df.withColumn("total", F.col("retrieval") + F.col("speed") + F.col("memory") + F.col("quality"))


def judged(results: DataFrame, criteria=("accuracy", "relevance", "completeness", "groundedness")) -> DataFrame:
    """One row: the mean of each criterion, of all of them (each answer's rounded to two digits), and the best and worst answer's id."""
    overall = F.round(sum((F.col(c) for c in criteria), F.lit(0.0)) / len(criteria), 2)
    df = results.withColumn("overall", overall)
    return df.agg(*[F.avg(c).alias(c) for c in criteria], F.avg("overall").alias("overall"), F.max_by("query_id", F.struct("overall", -F.col("query_id"))).alias("best"), F.min_by("query_id", F.struct("overall", "query_id")).alias("worst"))


def gains(before: DataFrame, after: DataFrame, truth: DataFrame, ks=(1, 5)) -> DataFrame:
    """One row: hit rates and MRR before and after, and what was gained."""
    a, b = recall_and_mrr(before, truth, ks), recall_and_mrr(after, truth, ks)
    names = [c for c in a.columns if c != "queries"]
    both = a.select(*[F.col(c).alias(f"{c}_before") for c in names]).crossJoin(b.select(*[F.col(c).alias(f"{c}_after") for c in names]))  # one row each
    return both.select("*", *[(F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_gain") for c in names])


def repeated_titles(hits: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n, titles): how many hits and how many different titles are among the k best."""
    return hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))


def unlike_titles(hits: DataFrame, k: int = 5) -> DataFrame:
    """The best hit of each title, ranked anew."""
    one = keep_first(hits, ["query_id", "title"], ["rank"])
    return top_k(one.withColumnRenamed("rank", "former"), k, tie="former").drop("former")


def by_document(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each hit for every chunk of its document (``corpus``: doc_id, document_name), at the same rank."""
    names = hits.join(corpus, "doc_id").select("query_id", "rank", "document_name")
    return names.join(corpus, "document_name").select("query_id", "doc_id", "rank")


def fused_by_document(dense: DataFrame, sparse: DataFrame, corpus: DataFrame, k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion in which a dense hit counts for every chunk of its document."""
    rows = by_document(dense, corpus).unionByName(sparse.select("query_id", "doc_id", "rank"))
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k)


def chunks_of_documents(corpus: DataFrame) -> DataFrame:
    """(document_name, chunks, first): how many chunks a document has, and the first of them."""
    return corpus.groupBy("document_name").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first"))


def sparse_shape(postings: DataFrame) -> DataFrame:
    """One row over (doc_id, term): mean, most and least terms of a document, and the size of the vocabulary."""
    per = postings.groupBy("doc_id").agg(F.countDistinct("term").alias("n")).agg(F.avg("n").alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"))
    return per.crossJoin(postings.agg(F.countDistinct("term").alias("vocabulary")))  # one row each


def crawl_report(pages: DataFrame, n: int = 20, at: str = "fetched_at", key: str = "url") -> DataFrame:
    """The ``n`` newest pages with the number of all. The order is total: ties by key."""
    total = pages.agg(F.count("*").alias("total"))
    return pages.orderBy(F.col(at).desc(), F.col(key)).limit(n).crossJoin(F.broadcast(total))  # one row


def run_summary(df: DataFrame, started: Column, ended: Column, key: str) -> DataFrame:
    """One row: first and last time, seconds between them, rows and keys."""
    return df.agg(F.min(started).alias("started"), F.max(ended).alias("ended"), (F.max(ended).cast("timestamp").cast("double") - F.min(started).cast("timestamp").cast("double")).alias("seconds"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))


def first_or_last(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a report; the order must be total."""
    return df.orderBy(*order).limit(n)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small report as a Markdown table."""
    rows = df.collect()
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
