"""Vector functions as column expressions over arrays, in double arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquery.schema import Metric

#: What a kernel gives where two vectors can't be compared.
FARTHEST_DOT, FARTHEST_L2, FARTHEST_COSINE = -3.4028234663852886e38, 3.4028234663852886e38, 2.0


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]) if len(vector) else F.array().cast("array<double>")


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; empty: 0; unequal lengths: the lowest float."""
    return F.when(F.size(a) == F.size(b), _dot(a, b)).when(a.isNotNull() & b.isNotNull(), F.lit(FARTHEST_DOT))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; empty: 0; unequal lengths: the highest float."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))).when(a.isNotNull() & b.isNotNull(), F.lit(FARTHEST_L2))


def norm(v: Column) -> Column:
    """Euclidean length; empty: 0."""
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine, clamped to [0, 2]; empty, unequal or zero vectors: 2. Stored norms may be given."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    value = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / F.nullif(scale, F.lit(0.0))))
    return F.when(ok, value).when(a.isNotNull() & b.isNotNull(), F.lit(FARTHEST_COSINE))


def cosine_prenormalised(a: Column, b: Column) -> Column:
    """1 - dot, for stored unit vectors."""
    return 1 - _dot(a, b)


def normalize(v: Column) -> Column:
    """v at unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / F.nullif(n, F.lit(0.0)))).otherwise(_doubles(v))


def distance(a: Column, b: Column, metric: Metric) -> Column:
    if metric is Metric.EUCLIDEAN:
        return l2_squared(a, b)
    return -dot(a, b) if metric is Metric.DOT else cosine_distance(a, b)


def score(distance: Column, metric: Metric) -> Column:
    """Higher is better: max(0, 1 - d), 1 / (1 + d), or the logistic of the dot product; not finite: 0."""
    if metric is Metric.EUCLIDEAN:
        value = 1 / (1 + distance)
    elif metric is Metric.DOT:
        value = 1 / (1 + F.exp(F.least(distance, F.lit(700.0))))
    else:
        value = F.greatest(F.lit(0.0), 1 - distance)
    bad = F.isnan(distance) | (F.abs(distance) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)
