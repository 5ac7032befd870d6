"""Vector columns over ``array<float>`` / ``array<double>``; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, clamp, col, let


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def cosine_to(a: ColumnOrName, query: list[float]) -> Column:
    """Cosine to a literal vector; its norm is folded on the driver."""
    qn = sum(float(v) ** 2 for v in query) ** 0.5
    if qn == 0:
        return F.when(col(a).isNotNull(), F.lit(0.0))
    n = norm(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, vector_literal(query)) / (n * F.lit(qn)))


def l2_normalize(a: ColumnOrName) -> Column:
    """Unit vector; a zero vector stays as it is."""
    # the norm is taken once a vector, not once an element; a zero vector is divided by 1
    return let(norm(a), lambda n: F.transform(col(a), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def clamped_dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return clamp(dot(a, b), -1.0, 1.0)


def weighted_sum(a: ColumnOrName, b: ColumnOrName, wa: float, wb: float) -> Column:
    """Unit vector of ``wa*a + wb*b`` with weights scaled to sum 1; one side missing gives the other."""
    total = wa + wb
    both = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * (wa / total) + y.cast("double") * (wb / total))
    return F.coalesce(l2_normalize(both), l2_normalize(a), l2_normalize(b))


def vector_error(a: ColumnOrName, dims: int) -> Column:
    """Null for a usable vector, else ``missing`` / ``dimension`` / ``not_finite``."""
    v = col(a)
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dims, "dimension")
        .when(F.exists(v, lambda x: _not_finite(x)), "not_finite")
    )


def first_bad_index(a: ColumnOrName) -> Column:
    """0-based index of the first value that is not finite, -1 when there is none."""
    bad = F.transform(col(a), lambda x: _not_finite(x))
    return (F.array_position(bad, True) - 1).cast("long")


def _not_finite(x: Column) -> Column:
    d = x.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
