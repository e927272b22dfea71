"""Tokens of languages that write several morphemes as one word: a lexicon of pieces learned from the words themselves.

A word is a chain of pieces, each with a probability. The first lexicon has all pieces of up to ``longest`` characters that occur
``least`` times, the ``size`` that cover most; rounds of expectation-maximisation then give each piece the number of times that it
is expected over all ways to part all words, and drop pieces that are hardly expected. Words are counted once over the corpus, so a
round reads the distinct words and not the texts; what is shuffled is a row for each piece and task. The lexicon is bounded by
``size`` and the alphabet, and goes to every task. Single characters stay, so every word can be parted. A word's tokens are its
likeliest chain (Viterbi; of equal ones that whose last piece is longest, then the one before).
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.sources.shared import staged


def word_counts(docs: DataFrame, words=tx.tokens, text: str = "text") -> DataFrame:
    """(word, n), written down."""
    return staged(docs.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")


def spread(words: DataFrame) -> DataFrame:
    """Words over as many tasks as shuffles have, and as there are cores at least: they are few bytes, which would be read by a few tasks,
    and each takes long."""
    spark = words.sparkSession
    return words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def first_lexicon(words: DataFrame, size: int, longest: int, least: int) -> dict[str, float]:
    """Log-probabilities of the pieces that cover most characters; single characters are always there."""
    n = F.char_length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.substring("word", i, k))))
    pieces = staged(words.filter("word <> ''").select(F.explode(spans).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    single = F.char_length("piece") == 1
    top = pieces.filter(~single & (F.col("n") >= least)).orderBy(F.desc(F.col("n") * F.char_length("piece")), "piece").limit(size)
    return normal({r.piece: float(r.n) for r in top.unionByName(pieces.filter(single)).collect()})


def normal(counts: dict[str, float]) -> dict[str, float]:
    total = math.fsum(counts.values())
    return {p: math.log(n / total) for p, n in counts.items() if n > 0}


def _sum(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def expected(word: str, lexicon: dict[str, float], longest: int) -> tuple[float, dict[str, float]]:
    """(log-likelihood of a word, how often each piece is expected in it) over all its chains."""
    n = len(word)
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    spans = [(i, j, word[i:j], p) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (p := lexicon.get(word[i:j])) is not None]
    for i, j, _, p in spans:
        ahead[j] = _sum(ahead[j], ahead[i] + p)
    for i, j, _, p in reversed(spans):
        behind[i] = _sum(behind[i], behind[j] + p)
    out: dict[str, float] = {}
    if ahead[n] > -math.inf:
        for i, j, piece, p in spans:
            out[piece] = out.get(piece, 0.0) + math.exp(ahead[i] + p + behind[j] - ahead[n])
    return ahead[n], out


def best(word: str, lexicon: dict[str, float], longest: int) -> list[str]:
    """The likeliest chain. A character that the lexicon does not have is a piece of its own, less likely than any."""
    worst = min(lexicon.values(), default=0.0) - 10
    at = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        ways = []
        for i in range(max(0, j - longest), j):
            p = lexicon.get(word[i:j], worst if j == i + 1 else None)
            if p is not None:
                ways.append((at[i][0] + p, -i))
        score, i = max(ways)
        at.append((score, -i))
    out, j = [], len(word)
    while j:
        i = at[j][1]
        out.append(word[i:j])
        j = i
    return out[::-1]


def train(words: DataFrame, size: int = 8000, longest: int = 6, least: int = 3, rounds: int = 4, floor: float = 0.5) -> tuple[dict[str, float], list[float]]:
    """(lexicon, log-likelihood of all words before each round and after the last). The likelihood rises from round to round, but for
    what dropping pieces costs."""
    spark = words.sparkSession
    lexicon, told = first_lexicon(words, size, longest, least), []
    for k in range(rounds + 1):
        sent = spark.sparkContext.broadcast(lexicon)

        def run(batches, sent=sent):
            total: dict[str, float] = {}
            likely = 0.0
            for b in batches:
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    p, counts = expected(word, sent.value, longest)
                    if counts:
                        likely += n * p
                    for piece, c in counts.items():
                        total[piece] = total.get(piece, 0.0) + n * c
            yield pa.RecordBatch.from_arrays([pa.array([None, *total], pa.string()), pa.array([likely, *total.values()], pa.float64())], names=["piece", "n"])

        sums = spread(words).mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        told.append(next((r.n for r in sums if r.piece is None), 0.0))
        if k < rounds:
            lexicon = normal({r.piece: r.n for r in sums if r.piece is not None and (r.n >= floor or len(r.piece) == 1)})
    return lexicon, told


def morphemes(word: Column, lexicon: dict[str, float], longest: int = 6) -> Column:
    """A word's likeliest pieces."""
    return F.pandas_udf(lambda s: pd.Series([None if w is None else best(w, lexicon, longest) for w in s]), "array<string>")(word)


def tokenizer(lexicon: dict[str, float], longest: int = 6, words=tx.tokens):
    """A ``words`` for ``retrieval.bm25`` and the others: each word's pieces in place of the word."""

    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [p for w in ws for p in best(w, lexicon, longest)])

    return lambda text: F.pandas_udf(pieces, "array<string>")(words(text))
