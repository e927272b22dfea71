"""Batch retrieval: a table of queries against a table of documents, ranked by cosine, BM25, or both.

The queries are the stated, bounded side and go to every task in blocks of bounded size; documents stay where they are, and
each task hands on its best k for each query, so what is shuffled is k rows a query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.sources.shared import staged

QUERY_BLOCK = 2000
#: Rows of documents that meet a block of queries at once, and numbers in the largest table of terms by queries.
DOC_ROWS, TABLE = 512, 4_000_000
#: A character's bits in a term's code; terms that a task sums up before it hands them on.
CHARACTER, HELD = (1 << 21) - 1, 1_000_000


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK):
    """Queries in blocks of bounded size."""
    rows = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


class Best:
    """The best k documents of each query so far, ties by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.docs = k, np.full((queries, 0), 0.0), np.zeros((queries, 0), np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: queries x docs, -inf where a document is no hit."""
        s = np.hstack([self.scores, scores])
        d = np.hstack([self.docs, np.broadcast_to(docs, scores.shape)])
        if s.shape[1] > 4 * self.k:
            # whatever could be among the best k: those that reach the k-th score, which are few but for ties
            kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = max(self.k, int((s >= kth).sum(1).max()))
            if width < s.shape[1]:
                near = np.argpartition(-s, width - 1, axis=1)[:, :width]
                s, d = np.take_along_axis(s, near, 1), np.take_along_axis(d, near, 1)
        order = np.lexsort((d, -s), axis=1)[:, : self.k]
        self.scores, self.docs = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        hit = np.isfinite(self.scores).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, self.scores.shape[1])[hit]), pa.array(self.docs.ravel()[hit]), pa.array(self.scores.ravel()[hit])], names=["query_id", "doc_id", "score"])


def top_k(df: DataFrame, k: int, score: str = "score", query: str = "query_id", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _unit(vectors: list | pa.Array, dim: int | None = None) -> np.ndarray:
    v = np.array(vectors, np.float64) if isinstance(vectors, list) else vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def dense(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of the largest cosine; ``queries``: query_id, vector; ``docs``: doc_id,
    vector. Null vectors are no hits and ask for nothing; all others have the dimension of the first query's, or the search
    fails."""
    spark, out = docs.sparkSession, None
    for block in query_blocks(queries.filter("vector is not null").select("query_id", "vector")):
        ids, dim = np.array([r[0] for r in block], np.int64), len(block[0][1])
        if any(len(r[1]) != dim for r in block):
            raise ValueError("queries differ in their vectors' dimension")
        q = _unit([r[1] for r in block])

        def run(batches, ids=ids, q=q, dim=dim):
            best = Best(len(ids), k)
            for whole in batches:
                for i in range(0, whole.num_rows, DOC_ROWS):
                    b = whole.slice(i, DOC_ROWS)
                    if (pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False) != dim).any():
                        raise ValueError(f"a document's vector does not have {dim} numbers")
                    best.add(b.column(0).to_numpy(), q @ _unit(b.column(1), dim).T)
            yield best.rows(ids)

        part = docs.filter("vector is not null").select(F.col("doc_id").cast("long"), "vector").mapInArrow(run, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(out, k)


# BM25 -----------------------------------------------------------------------------------------------------------------


def term_codes(texts: list[str], grams: tuple[int, ...] = (2, 3)) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code, long words) of every term of texts whose words are parted by single blanks: words, and the n-grams of their
    characters. A term of up to three characters has its characters as code, a longer one -1 less its number among the long
    words."""
    c = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    gap = (c == 32) | (c == 10)
    doc = np.cumsum(c == 10)
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(c) else np.zeros(0, np.int64)
    size = (np.flatnonzero(np.concatenate([gap, [True]])[1:] & ~gap) - begin + 1) if len(c) else begin
    docs, codes = [], []

    def add(at: np.ndarray, n: int) -> None:
        code = c[at]
        for k in range(1, n):
            code = (code << 21) | c[at + k]
        docs.append(doc[at])
        codes.append(code)

    for n in (1, 2, 3):
        add(begin[size == n], n)
    for n in grams:
        ok = ~gap[: len(c) - n + 1]
        for k in range(1, n):
            ok = ok & ~gap[k : len(c) - n + 1 + k]
        add(np.flatnonzero(ok), n)
    words = pc.split_pattern(pa.array(["\n".join(texts).replace("\n", " ")], pa.large_string()), " ").flatten()
    words = words.filter(pc.not_equal(words, "")).filter(pa.array(size > 3)).dictionary_encode() if len(begin) else pa.array([], pa.large_string()).dictionary_encode()
    docs.append(doc[begin[size > 3]])
    codes.append(-1 - words.indices.to_numpy().astype(np.int64))
    return np.concatenate(docs), np.concatenate(codes), words.dictionary


def spelled(codes: np.ndarray, long_words: pa.Array) -> pa.Array:
    """The terms of codes."""
    out = np.empty(len(codes), object)
    short = codes >= 0
    x = codes[short]
    x = np.where(x < 1 << 21, x << 42, np.where(x < 1 << 42, x << 21, x))  # the first character first
    out[short] = np.stack([(x >> 42) & CHARACTER, (x >> 21) & CHARACTER, x & CHARACTER], 1).astype("<u4").view("<U3").ravel()
    out[~short] = long_words.take(pa.array(-1 - codes[~short])).to_pylist()
    return pa.array(out, pa.string())


def plain(words, text: str):
    return F.array_join(words(text), " ")


def document_counts(doc: np.ndarray, code: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, number of documents) of every term of a batch of ``docs``. Characters are numbered within the batch, so a term and its
    document are one number, and plain numbers are what sorts fastest."""
    room = max(1, (docs - 1).bit_length())
    short = code >= 0
    x = code[short]
    parts = (x >> 42) & CHARACTER, (x >> 21) & CHARACTER, x & CHARACTER
    there = np.zeros(CHARACTER + 1, bool)
    for part in parts:
        there[part] = True
    there[0] = True  # no character
    chars = np.flatnonzero(there)
    bits = int(len(chars) - 1).bit_length()
    if 3 * bits + room > 63:
        every, number = np.unique(code, return_inverse=True)
        return every, np.bincount(np.unique(number * docs + doc) // docs, minlength=len(every))
    number = np.cumsum(there) - 1
    packed = number[parts[0]]
    for part in parts[1:]:
        packed = (packed << bits) | number[part]

    def counted(terms: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.sort((terms << room) | of)
        pairs = pairs[np.diff(pairs, prepend=-1) != 0] >> room
        at = np.flatnonzero(np.diff(pairs, prepend=-1))
        return pairs[at], np.diff(at, append=len(pairs))

    found, df = counted(packed, doc[short])
    least = (1 << bits) - 1
    codes = (chars[found >> 2 * bits] << 42) | (chars[(found >> bits) & least] << 21) | chars[found & least]
    long, long_df = counted(-1 - code[~short], doc[~short])
    return np.concatenate([codes, -1 - long]), np.concatenate([df, long_df])


def term_statistics(docs: DataFrame, words=tx.tokens, grams: tuple[int, ...] = (2, 3), text: str = "text") -> tuple[int, float, DataFrame]:
    """(number of documents, mean number of terms, (term, df)). Terms are counted where a document was read, and summed up over
    a task's batches as far as ``HELD`` goes; what is shuffled is a row for each term and task, or more where terms are many."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"])

    def run(batches):
        texts_read = terms_read = 0
        held: list[pa.Table] = []

        def rows():
            for b in summed(held).to_batches():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.zeros(b.num_rows, np.int64))], names=["term", "df", "terms"])

        for whole in batches:
            for i in range(0, whole.num_rows, DOC_ROWS):
                texts = whole.column(0).slice(i, DOC_ROWS).to_pylist()
                doc, code, long_words = term_codes(texts, grams)
                every, df = document_counts(doc, code, len(texts))
                texts_read, terms_read = texts_read + len(texts), terms_read + len(code)
                held.append(pa.table({"term": spelled(every, long_words), "df": pa.array(df, pa.int64())}))
                if sum(t.num_rows for t in held[1:]) > HELD:
                    held[:] = [summed(held)]
                    if held[0].num_rows > HELD:
                        yield from rows()
                        held.clear()
        if held:
            yield from rows()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([texts_read]), pa.array([terms_read])], names=["term", "df", "terms"])

    counts = docs.select(plain(words, text)).mapInArrow(run, "term string, df long, terms long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))
    counts = staged(counts, "terms")
    n, total = counts.filter("term is null").select("df", "terms").first() or (0, 0)
    return n, (total / n if n else 1.0) or 1.0, counts.filter("term is not null").select("term", "df")


def term_counts(docs: DataFrame, words=tx.tokens, grams: tuple[int, ...] = (2, 3), text: str = "text") -> DataFrame:
    """(doc_id, words, terms, distinct_terms) of each document, counted where it was read."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, DOC_ROWS):
                b = whole.slice(i, DOC_ROWS)
                doc, code, _ = term_codes(b.column(2).to_pylist(), grams)
                _, number = np.unique(code, return_inverse=True)
                distinct = np.bincount(np.unique(number * b.num_rows + doc) % b.num_rows, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.bincount(doc, minlength=b.num_rows).astype(np.int32)), pa.array(distinct.astype(np.int32))], names=["doc_id", "words", "terms", "distinct_terms"])

    rows = docs.select("doc_id", words(text).alias("w")).select("doc_id", F.size("w").alias("words"), F.array_join("w", " ").alias("t"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words int, terms int, distinct_terms int")


def okapi_idf(df: DataFrame, n_docs: int, epsilon: float = 0.25) -> DataFrame:
    """(term, idf) from (term, df): ln(N - df + .5) - ln(df + .5); a negative one becomes epsilon times the mean over all terms."""
    raw = df.select("term", (F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def sparse_idf(df: DataFrame, n_docs: int) -> DataFrame:
    """(term, weight) of sparse vectors, whose idf ln((N - df + .5) / (df + .5) + 1) is never negative. Both the query's vector
    and the document's carry it, so their product has its square."""
    idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.select("term", (idf * idf).alias("idf"))


def _query_blocks(weights: DataFrame):
    """Weights by query and term as (ids, terms, table), in blocks whose tables are bounded."""
    ids: dict[int, int] = {}
    terms: dict[str, int] = {}
    cells: list[tuple[int, int, float]] = []

    def block():
        table = np.zeros((len(terms), len(ids)))
        t, q, w = (np.array(x) for x in zip(*cells, strict=True))
        table[t, q] = w
        return np.array(list(ids), np.int64), list(terms), table

    rows = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    for r in rows.toLocalIterator():
        fresh = len({x[0] for x in r["w"]} - terms.keys())
        if ids and ((len(terms) + fresh) * (len(ids) + 1) > TABLE or len(ids) == QUERY_BLOCK):
            yield block()
            ids, terms, cells = {}, {}, []
        q = ids.setdefault(r["query_id"], len(ids))
        cells += [(terms.setdefault(x[0], len(terms)), q, x[1]) for x in r["w"]]
    if ids:
        yield block()


def _scorer(ids, terms, table, k: int, avgdl: float, k1: float, b: float, digits: int, grams: tuple[int, ...]):
    short = np.array([sum(ord(c) << 21 * (len(t) - 1 - i) for i, c in enumerate(t)) if len(t) <= 3 else -1 for t in terms], np.int64)
    order = np.argsort(short, kind="stable")
    ordered = short[order]
    long_at = np.flatnonzero(short < 0)
    long_terms = [terms[i] for i in long_at]
    asks = (table != 0).astype(np.float32)

    def run(batches):
        best = Best(len(ids), k)
        low, high, hits = np.full(len(ids), np.inf), np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        known = pa.array(long_terms, pa.large_string())
        for whole in batches:
            for i in range(0, whole.num_rows, DOC_ROWS):
                docs, texts = whole.column(0).slice(i, DOC_ROWS).to_numpy(), whole.column(1).slice(i, DOC_ROWS).to_pylist()
                doc, code, long_words = term_codes(texts, grams)
                dl = np.bincount(doc, minlength=len(texts))
                at = order[np.minimum(np.searchsorted(ordered, code), len(ordered) - 1)]
                at = np.where((code >= 0) & (short[at] == code), at, -1)
                found = pc.fill_null(pc.index_in(long_words, value_set=known), -1).to_numpy(zero_copy_only=False)
                is_long = code < 0
                number = found[-1 - code[is_long]]
                at[is_long] = np.where(number >= 0, np.append(long_at, -1)[number], -1)
                ok = at >= 0
                cells, tf = np.unique(doc[ok] * len(terms) + at[ok], return_counts=True)
                counts = np.zeros(len(texts) * len(terms))
                counts[cells] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[cells // len(terms)] / avgdl))
                counts = counts.reshape(len(texts), -1)
                score = np.round((counts @ table).T, digits)
                hit = ((counts != 0).astype(np.float32) @ asks).T > 0
                low = np.minimum(low, np.where(hit, score, np.inf).min(1, initial=np.inf))
                high = np.maximum(high, np.where(hit, score, -np.inf).max(1, initial=-np.inf))
                hits += hit.sum(1)
                best.add(docs, np.where(hit, score, -np.inf))
        rows = best.rows(ids)
        seen = hits > 0
        m, none = int(seen.sum()), lambda kind, n: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([*rows.columns, none(pa.float64(), rows.num_rows), none(pa.float64(), rows.num_rows), none(pa.int64(), rows.num_rows)], names=["query_id", "doc_id", "score", "lo", "hi", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), none(pa.int64(), m), none(pa.float64(), m), pa.array(low[seen]), pa.array(high[seen]), pa.array(hits[seen])], names=["query_id", "doc_id", "score", "lo", "hi", "n"])

    return run


def query_terms(queries: DataFrame, words=tx.tokens, grams: tuple[int, ...] = (2, 3), text: str = "text") -> DataFrame:
    """(query_id, term, qtf): the terms of queries and how often they occur in them."""

    def run(batches):
        for b_ in batches:
            q, texts = b_.column(0).to_numpy(), b_.column(1).to_pylist()
            doc, code, long_words = term_codes(texts, grams)
            every, number = np.unique(code, return_inverse=True)
            pairs, counts = np.unique(doc * max(1, len(every)) + number, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(q[pairs // max(1, len(every))]), spelled(every, long_words).take(pa.array(pairs % max(1, len(every)))), pa.array(counts)], names=["query_id", "term", "qtf"])

    flat = queries.select(F.col("query_id").cast("long"), plain(words, text))
    return flat.mapInArrow(run, "query_id long, term string, qtf long")


def bm25(queries: DataFrame, docs: DataFrame, k: int, words=tx.tokens, grams: tuple[int, ...] = (2, 3), idf=okapi_idf, normalised: bool = False, digits: int = 9, k1: float = 1.5, b: float = 0.75, text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query among those that share a term with it; scores are
    rounded to ``digits``, ties go to the smaller id. ``words``: text column -> array of words; ``grams``: n-grams of their
    characters that are terms too. Terms of a query count as often as they occur in it. If ``normalised``, scores are moved to
    0..1 for each query over all documents (``min_max``).

    Documents are read twice, for the statistics and for the scores, and never shuffled. Queries meet them as tables of
    weights, in blocks of bounded size."""
    spark = docs.sparkSession
    n, avgdl, df = term_statistics(docs, words, grams, text)
    asked = query_terms(queries, words, grams, text)
    weights = staged(asked.join(idf(df, n), "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight")), "weights")
    out = None
    for ids, terms, table in _query_blocks(weights):
        run = _scorer(ids, terms, table, k, avgdl, k1, b, digits, grams)
        part = docs.select(F.col("doc_id").cast("long"), plain(words, text)).mapInArrow(run, "query_id long, doc_id long, score double, lo double, hi double, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if not normalised:
        return top_k(out.filter("doc_id is not null").select("query_id", "doc_id", "score"), k)
    out = staged(out, "scores")
    stats = out.filter("doc_id is null").groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    hits = out.filter("doc_id is not null").select("query_id", "doc_id", "score")
    return top_k(min_max(hits, stats, n).withColumn("score", F.round("score", digits)), k)


def min_max(scores: DataFrame, stats: DataFrame, n_docs: int) -> DataFrame:
    """Scores to 0..1 for each query by the least and most (``stats``: query_id, lo, hi, n) over all documents, those without a
    score counting 0; score / max(max, 1) where all are equal."""
    some = F.col("n") < n_docs
    stats = stats.select("query_id", F.when(some, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(some, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("score") / F.greatest("hi", F.lit(1.0)))
    return scores.join(stats, "query_id").select("query_id", "doc_id", norm.alias("score"))


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over the union of both lists, a missing score counting 0."""
    a, b = dense_hits.select("query_id", "doc_id", F.col("score").alias("s")), sparse_hits.select("query_id", "doc_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").fillna(0.0, ["s", "b"])
    return top_k(both.select("query_id", "doc_id", (alpha * F.col("s") + (1 - alpha) * F.col("b")).alias("score")), k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    rows = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "doc_id", "rank"))
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k)


def drop_below(hits: DataFrame, least: float = 0.4) -> DataFrame:
    """All hits of a query go where its best score is below ``least``."""
    w = Window.partitionBy("query_id")
    return hits.withColumn("__m", F.max("score").over(w)).filter(F.col("__m") >= least).drop("__m")


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): texts by rank, numbered, joined; blank ones are left out but keep their number. At most k a query."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.btrim("text"))
    rows = hits.filter(F.btrim("text") != "").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n---\n\n").alias("context"))


def rerank(hits: DataFrame, scorer, k: int, chars: int = 512) -> DataFrame:
    """Score (query, text) pairs again by ``scorer``, a function of two columns, on the first ``chars`` characters."""
    return top_k(hits.drop("rank").withColumn("score", scorer(F.col("query"), F.left("text", F.lit(chars)))), k)
