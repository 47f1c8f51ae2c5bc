"""Vector expressions as columns: dense vectors are arrays, multi-vectors arrays of arrays.

Sums are over doubles.  Vectors of unequal lengths have a null product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the product of norms, so that zero vectors have similarity 0.
EPS = 1e-9


def vector(values: list[float]) -> Column:
    """A literal vector."""
    return F.array(*(F.lit(float(x)) for x in values)).cast("array<double>")


def multi_vector(rows: list[list[float]]) -> Column:
    return F.array(*map(vector, rows))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    product = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """norm_a, norm_b: norms that are stored already."""
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + EPS)


def unit(a: Column) -> Column:
    """a divided by its norm; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def maxsim(q: Column, d: Column) -> Column:
    """For each vector of q its best product with one of d, summed."""
    return _sum(F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))))


SCORERS = {"dot": dot, "cosine": cosine, "maxsim": maxsim}


def scorer(name: str | None = None, *, multi: bool = False):
    """A scorer by name, or the one that fits the kind of embedding."""
    return SCORERS[name or ("maxsim" if multi else "cosine")]
