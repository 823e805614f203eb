"""The data model: documents, change log, manifests, and the search request with its validation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any

from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False), T.StructField("text", T.StringType()), T.StructField("attributes", T.StringType())])
#: One change: an upsert of a document or a delete of ids; (ts, seq) orders them.
CHANGE = T.StructType([T.StructField("ts", T.LongType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), *[T.StructField(f.name, f.dataType) for f in DOCUMENT]])
TOMBSTONES = T.StructType([T.StructField("id", T.StringType(), False)])


class Metric(StrEnum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean_squared"
    DOT = "dot_product"

    @classmethod
    def parse(cls, name: str | None) -> Metric:
        """Known names and their short forms; anything else is cosine."""
        name = (name or "").lower()
        if name in ("euclidean", "euclidean_squared"):
            return cls.EUCLIDEAN
        return cls.DOT if name in ("dot", "dot_product") else cls.COSINE


class Mode(StrEnum):
    VECTOR = "vector"
    TEXT = "text"
    HYBRID = "hybrid"


class Fusion(StrEnum):
    BLEND = "blend"
    RRF = "rrf"


@dataclass(frozen=True)
class SearchRequest:
    """A search over one namespace. ``ef_search`` is accepted and has no effect: exact and IVF scans have no such beam.
    ``nprobe`` None: as many clusters as an index needs for its recall; 0: 10."""

    vector: tuple[float, ...] | None = None
    text: str | None = None
    mode: str | None = None
    alpha: float = 0.7
    fusion: str | None = None
    rrf_k: int = 60
    top_k: int = 10
    ef_search: int | None = None
    nprobe: int | None = None
    distance_metric: str = "cosine"
    include_vectors: bool = False
    filters: dict[str, Any] | None = field(default=None, hash=False)
    stats_scope: str = "global"

    @property
    def metric(self) -> Metric:
        return Metric.parse(self.distance_metric)

    def resolved(self, dimensions: int | None = None, max_top_k: int = 1000) -> ResolvedRequest:
        """The request with defaults applied; ValueError where it can't be answered."""
        has_text = bool((self.text or "").strip())
        has_vector = bool(self.vector)
        if self.mode is None:
            mode = Mode.HYBRID if has_vector and has_text else Mode.TEXT if has_text else Mode.VECTOR
        else:
            mode = Mode(self.mode)  # an unknown mode is a ValueError
        if mode is not Mode.TEXT and not has_vector:
            raise ValueError("vector is required" if mode is Mode.VECTOR else "vector and text are required")
        if mode is not Mode.VECTOR and not has_text:
            raise ValueError("text is required" if mode is Mode.TEXT else "vector and text are required")
        if has_vector and not all(math.isfinite(x) for x in self.vector):
            raise ValueError("vector must be finite")
        if has_vector and dimensions and mode is not Mode.TEXT and len(self.vector) != dimensions:
            raise ValueError(f"dimension mismatch: {len(self.vector)} != {dimensions}")
        k = self.top_k if self.top_k and self.top_k > 0 else 10
        k = min(k, max_top_k) if max_top_k else k
        return ResolvedRequest(self, mode, Fusion.RRF if (self.fusion or "").lower() == "rrf" else Fusion.BLEND, min(1.0, max(0.0, self.alpha)), max(1, self.rrf_k), k, candidates(k))


@dataclass(frozen=True)
class ResolvedRequest:
    request: SearchRequest
    mode: Mode
    fusion: Fusion
    alpha: float
    rrf_k: int
    top_k: int
    candidates: int


def candidates(k: int) -> int:
    """How many candidates each list keeps before fusion."""
    return max(4 * k, k + 10)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def duration(text: str) -> float:
    """Seconds of a duration as people write it: 300, 5m, 1h30m, 1.5s, 250ms."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*(ns|us|µs|ms|s|m|h|d)", text.strip().lower())
    if not parts or "".join(a + b for a, b in parts) != re.sub(r"\s", "", text.lower()):
        try:
            return float(text)
        except ValueError:
            raise ValueError(f"not a duration: {text}") from None
    return sum(float(a) * _UNITS[b] for a, b in parts)
