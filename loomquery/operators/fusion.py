"""Fusion of a vector list and a text list of (id, score), both already cut to their candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from loomquery.operators.knn import ranking, top

# Windows without a partition are used on candidate lists only: a few dozen rows.
def _all() -> WindowSpec:
    return W.partitionBy()



def max_normalised(score: str) -> Column:
    """score over the highest score of all rows; 0 where that isn't positive."""
    most = F.max(score).over(_all())
    return F.when(most > 0, F.col(score) / F.nullif(most, F.lit(0.0))).otherwise(F.lit(0.0))


def normalise(listed: DataFrame) -> DataFrame:
    return listed.select("id", max_normalised("score").alias("score"))


def _outer(vector: DataFrame, text: DataFrame, value: str) -> DataFrame:
    v, t = vector.select("id", F.col(value).alias("v")), text.select("id", F.col(value).alias("t"))
    return v.join(t, "id", "full_outer").select("id", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("t", F.lit(0.0)).alias("t"))


def blend(vector: DataFrame, text: DataFrame, alpha: float = 0.7) -> DataFrame:
    """(id, score): alpha of the normalised vector score and the rest of the text score; a missing side is 0."""
    alpha = min(1.0, max(0.0, alpha))
    return _outer(normalise(vector), normalise(text), "score").select("id", (F.col("v") * alpha + F.col("t") * (1 - alpha)).alias("score"))


def rrf(vector: DataFrame, text: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): reciprocal ranks of both lists summed."""
    k = max(1, k)
    part = lambda listed: listed.select("id", (1.0 / (F.row_number().over(_all().orderBy(*ranking())) + k)).alias("part"))
    return _outer(part(vector), part(text), "part").select("id", (F.col("v") + F.col("t")).alias("score"))


def fuse(vector: DataFrame, text: DataFrame, k: int, how: str = "blend", alpha: float = 0.7, rrf_k: int = 60) -> DataFrame:
    """(rank, id, score) of the k best."""
    merged = rrf(vector, text, rrf_k) if how == "rrf" else blend(vector, text, alpha)
    return top(merged, k).select("rank", "id", "score")
