"""Scalar quantization: 8 bits a dimension with calibrated ranges, or IEEE half precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions import vectors as V
from loomquery.operators.knn import top
from loomquery.schema import Metric

RERANK = 4


def calibrate(rows: DataFrame) -> DataFrame:
    """(dim, min, scale): the range of each dimension without NaN; scale 1 where the range is empty or not finite."""
    values = rows.select(F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x")).where(~F.isnan("x"))
    range_ = values.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    infinite = (F.abs("lo") == float("inf")) | (F.abs("hi") == float("inf"))
    scale = F.when(infinite | (F.col("hi") <= F.col("lo")), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / 255)
    return range_.select("dim", F.when(infinite, F.lit(0.0)).otherwise(F.col("lo")).alias("min"), scale.alias("scale"))


def collected(calibration: DataFrame) -> tuple[list[float], list[float]]:
    """The calibration as two lists: a row a dimension, so bounded."""
    rows = sorted(calibration.collect(), key=lambda r: r["dim"])
    return [r["min"] for r in rows], [r["scale"] for r in rows]


def encode(vector: Column, lo: Sequence[float], scale: Sequence[float]) -> Column:
    """The codes, 0 to 255."""
    ranges = F.arrays_zip(V.literal(lo).alias("lo"), V.literal(scale).alias("scale"))
    return F.zip_with(vector.cast("array<double>"), ranges, lambda x, r: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x - r["lo"]) / r["scale"]).cast("int"))))


def approximate_distance(code: Column, query: Sequence[float], lo: Sequence[float], scale: Sequence[float], metric: Metric, norm: Column | None = None) -> Column:
    """Distance of a code from a full-precision query; the cosine takes the stored norm of the original vector."""
    codes = code.cast("array<double>")
    if metric is Metric.EUCLIDEAN:
        ranges = F.arrays_zip(V.literal(lo).alias("lo"), V.literal(scale).alias("scale"), V.literal(query).alias("q"))
        off = F.zip_with(codes, ranges, lambda c, r: r["lo"] + c * r["scale"] - r["q"])
        return F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x)
    base = float(sum(q * m for q, m in zip(query, lo)))
    steps = V.literal([q * s for q, s in zip(query, scale)])
    dot = F.aggregate(F.zip_with(codes, steps, lambda c, s: c * s), F.lit(base), lambda a, x: a + x)
    if metric is Metric.DOT:
        return -dot
    length = float(np.sqrt(sum(q * q for q in query)))
    return F.when((norm > 0) & F.lit(length > 0), 1 - dot / F.nullif(norm * length, F.lit(0.0))).otherwise(F.lit(V.FARTHEST_COSINE))


def rerank(coded: DataFrame, query: Sequence[float], k: int, lo: Sequence[float], scale: Sequence[float], metric: Metric = Metric.COSINE, factor: int = RERANK) -> DataFrame:
    """(rank, id, score): the factor * k nearest by code, then the k nearest of these by their full vectors.
    coded: (id, vector, code, norm)."""
    near = coded.select("id", "vector", (-approximate_distance(F.col("code"), query, lo, scale, metric, F.col("norm"))).alias("score"))
    few = near.orderBy(F.round("score", 9).desc(), "id").limit(k * factor)
    exact = V.score(V.distance(F.col("vector"), V.literal(query), metric), metric)
    return top(few.select("id", exact.alias("score")), k).select("rank", "id", "score")


def code_error(scale: Sequence[float]) -> float:
    """How far a decoded vector may be from that whose code it is: half a step a dimension."""
    return 0.5 * float(np.sqrt(sum(s * s for s in scale))) * (1 + 1e-9)


def half_error(norm: Column, dimensions: int) -> Column:
    """The same for halves of a vector of this length: half a unit in the last place a dimension, or half the least number."""
    return norm * F.lit(2.0**-11 * (1 + 1e-9)) + F.lit(float(np.sqrt(dimensions)) * 2.0**-25)


def score_bounds(distance: Column, error: Column, query: Sequence[float], metric: Metric, norm: Column, exact_norm: bool) -> tuple[Column, Column]:
    """The least and the highest score that a row may have whose vector is within error of one at this distance. exact_norm: the
    cosine was taken with the norm of the row's vector. A distance that isn't finite says nothing."""
    if metric is Metric.EUCLIDEAN:
        root = F.sqrt(distance)
        near, far = F.pow(F.greatest(F.lit(0.0), root - error), 2), F.pow(root + error, 2)
    else:
        off = error * float(np.sqrt(sum(q * q for q in query)))
        if metric is Metric.COSINE:
            off = F.when(norm > 0, error * (1 if exact_norm else 2) / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(0.0))
        near, far = distance - off, distance + off
    unknown = distance.isNull() | F.isnan(distance) | (F.abs(distance) == float("inf"))
    return F.when(unknown, F.lit(0.0)).otherwise(V.score(far, metric)), F.when(unknown, F.lit(float("inf"))).otherwise(V.score(near, metric))


def possible(rows: DataFrame, low: Column, high: Column, k: int) -> DataFrame:
    """rows that may be among the k of highest score, by bounds of it: those whose highest score reaches the k-th of the least
    ones, ties of 9 digits included."""
    kth = rows.select(low.alias("low")).orderBy(F.col("low").desc()).limit(k).agg(F.when(F.count("*") == k, F.min("low")).alias("_kth"))
    return rows.crossJoin(F.broadcast(kth)).where(F.col("_kth").isNull() | (high >= F.col("_kth") - 2e-9)).drop("_kth")


def _halves(column: pa.Array) -> pa.Array:
    """Each vector as the bytes of its halves: one cast of all values, then slices of their bytes."""
    n = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float16)
    offsets = np.append(0, np.cumsum(2 * n)).astype(np.int32)
    none = None if not column.null_count else pa.py_buffer(np.packbits(pc.is_valid(column).to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(column), [none, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def with_half(rows: DataFrame) -> DataFrame:
    """rows with the vector's halves as a column ``half``."""

    @F.arrow_udf("binary")
    def half(v: pa.Array) -> pa.Array:
        return _halves(v)

    return rows.withColumn("half", half("vector"))


def to_half(rows: DataFrame) -> DataFrame:
    """(id, half): vectors as bytes of IEEE halves."""
    return with_half(rows.select("id", "vector")).select("id", "half")


def half_vectors(coded: DataFrame, name: str = "vector") -> DataFrame:
    """coded with the vectors back from its halves."""

    @F.arrow_udf("array<float>")
    def back(h: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.binary_length(h), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        flat = np.frombuffer(b"".join(x for x in h.to_pylist() if x), np.float16).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat), mask=pc.is_null(h))

    return coded.withColumn(name, back("half")).drop("half")
