"""Models as functions of columns. A pipeline takes any of these; none of them is part of this library.

* an embedder makes vectors of texts, a scorer marks pairs of texts, a generator answers a system and a user message, a reader
  makes text of a picture;
* each is loaded once in a Python worker, however many batches it sees, and works on Arrow batches;
* ``hashed_embedding`` needs no model: tests and examples run with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.vectors import l2_normalize, let

#: Names of embedding providers and what their texts begin with (``text.prefixed``), if anything.
PROVIDERS = {"e5": "e5", "bge": "", "openai": "", "upstage": "", "kosimcse": "", "krsbert": ""}


def _once(load: Callable[[], Callable], kind: str):
    """A function of columns around a model that ``load`` gives; the model takes lists, one for each column."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series(list(model(*[c.tolist() for c in columns])))

    return run, kind


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    run, _ = _once(load, "")

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return F.pandas_udf(one, "array<float>")


def scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    run, _ = _once(load, "")

    def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from run(batches)

    return F.pandas_udf(pairs, "double")


def generator(load: Callable[[], Callable[[list[str], list[str]], list[str]]]) -> Callable[[Column, Column], Column]:
    run, _ = _once(load, "")

    def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from run(batches)

    return F.pandas_udf(pairs, "string")


def reader(load: Callable[[], Callable[[list[bytes]], list[str]]]) -> Callable[[Column], Column]:
    run, _ = _once(load, "")

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return F.pandas_udf(one, "string")


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Words counted in ``dim`` boxes by their MD5, of length 1."""
    boxes = F.transform(tx.tokens(text), lambda w: F.pmod(F.conv(F.left(F.md5(w), F.lit(6)), 16, 10).cast("long"), F.lit(dim)))
    counts = let(boxes, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    return l2_normalize(counts)
