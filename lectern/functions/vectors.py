"""Vector functions over arrays, in doubles."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: what stands in a function of an array's elements is made for each of them."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v) -> Column:
    """A zero vector stays as it is."""
    scaled = lambda u, norm: F.transform(u, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
    return let(v, lambda u: let(F.sqrt(dot(u, u)), lambda norm: scaled(u, norm)))
