"""Vector algebra on ARRAY<DOUBLE> (dense) and MAP<INT,DOUBLE> (sparse, 0-based) columns.

A missing sparse index counts as 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.session import MAX_FLOAT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v)


def fold(a, start, step) -> Column:
    """Reduce a vector with a Column lambda (s, v) -> s."""
    return F.aggregate(_c(a), F.lit(start), step)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p + q)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p - q)


def hadamard(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p * q)


def scale(a, factor) -> Column:
    k = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_c(a), lambda v: v * k)


def square(a) -> Column:
    return F.transform(_c(a), lambda v: v * v)


def dot(a, b) -> Column:
    return total(hadamard(a, b))


def sq_distance(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)))


def distance(a, b) -> Column:
    """Euclidean distance; a NULL vector is infinitely far away."""
    return F.coalesce(F.sqrt(sq_distance(a, b)), F.lit(MAX_FLOAT))


def element(a, i: int) -> Column:
    """0-based component; a NULL vector reads as 0."""
    return F.coalesce(F.get(_c(a), F.lit(i)), F.lit(0.0))


def with_element(a, i: int, value) -> Column:
    v = value if isinstance(value, Column) else F.lit(float(value))
    return F.transform(_c(a), lambda e, j: F.when(j == i, v).otherwise(e))


def zeros(d: int) -> Column:
    return F.array_repeat(F.lit(0.0), d)


# ---- sparse -----------------------------------------------------------------------------


def sparse_element(m, i: int) -> Column:
    return F.coalesce(F.element_at(_c(m), F.lit(i)), F.lit(0.0))


def _or_zero(v: Column) -> Column:
    return F.coalesce(v, F.lit(0.0))


def sparse_zip(a, b, f) -> Column:
    return F.map_zip_with(_c(a), _c(b), lambda _k, p, q: f(_or_zero(p), _or_zero(q)))


def sparse_add(a, b) -> Column:
    return sparse_zip(a, b, lambda p, q: p + q)


def sparse_dot(a, b) -> Column:
    return total(F.map_values(sparse_zip(a, b, lambda p, q: p * q)))


def sparse_distance(a, b) -> Column:
    return F.sqrt(total(F.map_values(sparse_zip(a, b, lambda p, q: (p - q) * (p - q)))))


def to_sparse(a) -> Column:
    """Dense to sparse, zeros left out."""
    pairs = F.filter(
        F.transform(_c(a), lambda v, i: F.struct(i.alias("key"), v.alias("value"))),
        lambda e: e["value"] != 0.0,
    )
    return F.map_from_entries(pairs)


def to_dense(m, d: int) -> Column:
    col = _c(m)
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: _or_zero(F.element_at(col, i)))


def sparse_dense_dot(m, a) -> Column:
    return total(F.transform(_c(a), lambda v, i: v * _or_zero(F.element_at(_c(m), i))))


def sparse_dense_distance(m, a) -> Column:
    def gap(v, i):
        return v - _or_zero(F.element_at(_c(m), i))

    return F.sqrt(total(F.transform(_c(a), lambda v, i: gap(v, i) * gap(v, i))))
