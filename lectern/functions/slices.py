"""Functions of Python values as columns, a slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows of a slice at most, and bytes of its columns beyond which no further row is taken.
ROWS, BYTES = 256, 1 << 20


def cut(columns: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """Columns of one batch in slices of so many rows and bytes; a row that is longer is a slice of its own."""
    n, at = len(columns[0]), 0
    while at < n:
        rows = min(ROWS, n - at)
        while rows > 1 and sum(c.slice(at, rows).nbytes for c in columns) > BYTES:
            rows //= 2
        yield [c.slice(at, rows) for c in columns]
        at += rows


def sliced(f: Callable[..., list], returns: str) -> Callable[..., Column]:
    """``f`` takes a list of values for each column and returns a list. Batches come and go as Arrow arrays; Python's objects, which take
    several times their room, live as long as a slice of them."""
    kind = to_arrow_type(DataType.fromDDL(returns))

    def run(*columns: pa.Array) -> pa.Array:
        found = [pa.array(f(*(c.to_pylist() for c in part)), kind) for part in cut(list(columns))]
        return pa.concat_arrays(found) if found else pa.array([], kind)

    return F.arrow_udf(run, returns)
