"""Vector expressions on ARRAY<FLOAT> columns (higher-order functions, JVM-side).

All accumulation is done in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE_EPS = 1e-9           # fixed value: denominators below this give cosine 0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    den = norm(a) * norm(b)
    return F.when(den < COSINE_EPS, F.lit(0.0)).otherwise(dot(a, b) / den)


def unit(a) -> Column:
    """a / |a|, or all zeros for a (near) zero vector."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n < COSINE_EPS, F.lit(0.0)).otherwise(x.cast("double") / n))


def sum_vectors(list_col) -> Column:
    """Element-wise sum of an array of equally long vectors (NULL for empty)."""
    lst = _c(list_col)
    first = to_double(F.element_at(lst, 1))
    zero = F.transform(first, lambda x: F.lit(0.0))
    return F.when(F.size(lst) > 0, F.aggregate(
        lst, zero, lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q.cast("double"))))


def sum_units(list_col, vector: str, norm_field: str) -> Column:
    """Element-wise sum of ``unit`` over an array of (vector, its norm), NULL for empty."""
    lst = _c(list_col)
    zero = F.transform(F.element_at(lst, 1)[vector], lambda x: F.lit(0.0))
    return F.when(F.size(lst) > 0, F.aggregate(lst, zero, lambda acc, s: F.zip_with(
        acc, s[vector], lambda p, q: p + F.when(s[norm_field] < COSINE_EPS, F.lit(0.0))
        .otherwise(q.cast("double") / s[norm_field]))))


def pairwise_diversity(sum_unit, n_vectors, n_nonzero) -> Column:
    """Mean of (1 - cos) over all pairs, from the sum of unit vectors:
    sum_{i<j} cos = (|sum u|^2 - m) / 2 with m non-zero vectors; fewer than 2
    vectors -> NULL."""
    n = _c(n_vectors).cast("double")
    s2 = dot(sum_unit, sum_unit)
    return F.when(n >= 2, F.lit(1.0) - (s2 - _c(n_nonzero)) / (n * (n - 1)))
