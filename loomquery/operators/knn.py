"""Nearest neighbours: exact scans for one query, many queries and whole tables; recall.

Scans score Arrow batches by one matrix product and keep only each batch's best rows (every row is scored, ties are
kept), so that what is shuffled is k rows a batch and query, whatever the table's size. The order everywhere is score
rounded to 9 digits, descending, then id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomquery.functions import vectors as V
from loomquery.schema import Metric, candidates

SIMPLE = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vectors have these dimensions, as a double matrix, and their positions."""
    lengths = pc.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(lengths == dimensions)
    if len(ok) < len(lengths):
        column = column.take(pa.array(ok))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(ok), dimensions), ok


def distances(rows: np.ndarray, queries: np.ndarray, metric: Metric) -> np.ndarray:
    """A row a query, a column a row."""
    if metric is Metric.EUCLIDEAN:
        # differences, as the form by products loses digits near zero; a query at a time, so that it stays in the cache
        out = np.empty((len(queries), len(rows)))
        for i, q in enumerate(queries):
            for at in range(0, len(rows), 4096):
                off = rows[at : at + 4096] - q
                out[i, at : at + 4096] = np.einsum("ij,ij->i", off, off)
        return out
    products = queries @ rows.T
    if metric is Metric.DOT:
        return -products
    scale = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((rows**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, 1 - np.clip(products / scale, -1, 1), V.FARTHEST_COSINE)


def scores(distance: np.ndarray, metric: Metric) -> np.ndarray:
    with np.errstate(over="ignore"):
        if metric is Metric.EUCLIDEAN:
            value = 1 / (1 + distance)
        elif metric is Metric.DOT:
            value = 1 / (1 + np.exp(distance))
        else:
            value = np.maximum(0, 1 - distance)
    return np.where(np.isfinite(distance), value, 0.0)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, and of all that tie with the last."""
    rounded = np.round(score, 9)
    if len(rounded) <= k:
        return np.arange(len(rounded))
    return np.flatnonzero(rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k])


def ranking(score: str = "score", id: str = "id") -> list[Column]:
    return [F.round(score, 9).desc(), F.col(id).asc()]


def top(scored: DataFrame, k: int, partition: Sequence[str] = ()) -> DataFrame:
    """The k best of each partition with their ranks; without a partition a bounded sort, whatever the size."""
    if not partition:
        scored = scored.orderBy(*ranking()).limit(k)
    w = W.partitionBy(*partition).orderBy(*ranking())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_rows(rows: DataFrame, queries: Sequence[tuple], metric: Metric, k: int, segment: str | None = None) -> DataFrame:
    """(query_id, [segment,] id, score): of each batch, at least the k best rows for each query. rows: (id, vector
    [, segment]); queries: (query_id, vector), all of one length. Rows of other lengths have no score."""
    id_kind = rows.schema["id"].dataType.simpleString()
    query_kind = "bigint" if isinstance(queries[0][0], int) else "string"
    ids = [q for q, _ in queries]
    wanted = np.array([v for _, v in queries], np.float64)
    extra = f"{segment} {rows.schema[segment].dataType.simpleString()}, " if segment else ""
    names = ["query_id", *([segment] if segment else []), "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, ok = matrix(batch.column("vector"), wanted.shape[1])
            if not len(ok):
                continue
            s = scores(distances(got, wanted, metric), metric)
            part = np.array(batch.column(segment).to_pylist())[ok] if segment else np.zeros(len(ok), np.int8)
            query, row = [], []
            for value in np.unique(part):
                own = np.flatnonzero(part == value)
                for q in range(len(ids)):
                    at = own[best(s[q, own], k)]
                    query.append(np.full(len(at), q))
                    row.append(at)
            q, r = np.concatenate(query), np.concatenate(row)
            take = pa.array(ok[r])
            columns = [pa.array([ids[i] for i in q], pa.int64() if query_kind == "bigint" else pa.string())]
            columns += [batch.column(segment).take(take)] if segment else []
            yield pa.RecordBatch.from_arrays([*columns, batch.column("id").take(take), pa.array(s[q, r])], names)

    return rows.select("id", "vector", *([segment] if segment else [])).mapInArrow(run, f"query_id {query_kind}, {extra}id {id_kind}, score double")


def exact_knn(rows: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """(rank, id, score) of the k nearest rows of (id, vector)."""
    return top(score_rows(rows, [(0, query)], metric, k).select("id", "score"), k).select("rank", "id", "score")


def exact_knn_columns(rows: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """The same without Python, by column expressions."""
    d = V.distance(F.col("vector"), V.literal(query), metric)
    return top(rows.select("id", V.score(d, metric).alias("score")), k).select("rank", "id", "score")


def batch_knn(rows: DataFrame, queries: Sequence[tuple], k: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """(query_id, rank, id, score) for many queries in one scan."""
    return top(score_rows(rows, queries, metric, k), k, ["query_id"]).select("query_id", "rank", "id", "score")


def segment_candidates(rows: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE, segment: str = "segment") -> DataFrame:
    """(segment, rank, id, score): the over-fetched candidates of each segment."""
    n = candidates(k)
    return top(score_rows(rows, [(0, query)], metric, n, segment).drop("query_id"), n, [segment]).select(segment, "rank", "id", "score")


def knn_join(left: DataFrame, right: DataFrame, k: int, metric: Metric = Metric.COSINE, block_rows: int = 20_000, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of right for every row of left, both (id, vector). Both sides are
    cut into blocks by counts, every pair of blocks is one matrix product, and only k rows a query and block go on."""
    id_kind = left.schema["id"].dataType.simpleString()
    a, b = (max(1, -(-side.count() // block_rows)) for side in (left, right))
    block = lambda side, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    x = left.select("id", "vector", block(left, a).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("j"))
    y = right.select(F.col("id").alias("other"), F.col("vector").alias("other_vector"), block(right, b).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("i"))

    pair = block_pairs(k, metric, exclude_self)
    found = x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(pair, f"query_id {id_kind}, id {id_kind}, score double")
    return top(found, k, ["query_id"]).select("query_id", "rank", "id", "score")


#: Products held at once, and pairs scored at once.
TILE, PAIRS = 1 << 22, 1 << 15


def units(rows: np.ndarray) -> np.ndarray:
    """rows at unit length; without a direction: zeros."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((rows**2).sum(1))
    ok = np.isfinite(length) & (length > 0)
    return np.divide(rows, length[:, None], out=np.zeros_like(rows), where=ok[:, None])


def likely(products: np.ndarray, rows: int, k: int, floor: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) of products, each off by at most error, that may be among the k highest of their query; the
    columns from rows on don't count. The k-th of the highest products of k or more disjoint groups of rows bounds the k-th
    highest of all from below, so only groups are sorted. floor: what the rows before rule out for each query, which is raised.
    Scores of zero, those of products up to zero, are ties: where these may be needed, all rows may be."""
    width = max(64, 4 * k)
    groups = products.shape[1] // width
    if groups < 2:
        products = products[:, :rows]
        if rows > k:
            _raise(floor, np.partition(products, rows - k, axis=1)[:, rows - k], error)
        return np.nonzero(products >= floor[:, None])
    products[:, rows:] = -2
    parts = products.reshape(len(products), groups, width)
    highest = parts.max(axis=1)
    _raise(floor, np.partition(highest, width - k, axis=1)[:, width - k], error)
    q, part = np.nonzero(highest >= floor[:, None])
    at, group = np.nonzero(parts[q, :, part] >= floor[q][:, None])
    return q[at], group * width + part[at]


def _raise(floor: np.ndarray, kth: np.ndarray, error: float) -> None:
    np.maximum(floor, np.where(kth > 2 * error, kth - 2 * error, -1.5), out=floor)


def padded(rows: np.ndarray, k: int) -> np.ndarray:
    """rows as floats, filled up to whole groups of ``likely``."""
    width = max(64, 4 * k)
    out = np.zeros((len(rows) if len(rows) < 2 * width else -(-len(rows) // width) * width, rows.shape[1]), np.float32)
    out[: len(rows)] = rows
    return out


def cut(query: np.ndarray, row: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties by the rank of the row's id."""
    order = np.lexsort((rank[row], -np.round(score, 9), query))
    query, row, score = query[order], row[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    keep = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < k
    return query[keep], row[keep], score[keep]


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, metric: Metric, rank: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (query, row) and scores of the k best rows of each query, ties by rank. For cosines, of which both sides are
    given as ``units``, products of floats find what may be among the best, and only that is scored in doubles. same: numbers of
    the ids of both sides, pairs of one number don't count. floor: see ``likely``."""
    wide = k
    if same is not None and len(rows):
        wide += int(np.unique(same[1], return_counts=True)[1].max())
    floor = np.full(len(queries), -1.5, np.float32) if floor is None else floor
    cosine = metric is Metric.COSINE
    right = padded(rows, wide) if cosine else rows
    error = (rows.shape[1] + 16) * 2.0**-23
    out = []
    step = max(1, TILE // max(1, len(right)))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        if cosine:
            q, r = likely(some.astype(np.float32) @ right.T, len(rows), wide, floor[at : at + step], error)
            s = np.empty(len(q))
            for i in range(0, len(q), PAIRS):
                s[i : i + PAIRS] = scores(1 - np.clip(np.einsum("ij,ij->i", some[q[i : i + PAIRS]], rows[r[i : i + PAIRS]]), -1, 1), metric)
        else:
            all_ = scores(distances(rows, some, metric), metric)
            hits = [best(x, wide) for x in all_]
            q, r = np.repeat(np.arange(len(some)), [len(x) for x in hits]), np.concatenate(hits)
            s = all_[q, r]
        if same is not None:
            other = same[0][at + q] != same[1][r]
            q, r, s = q[other], r[other], s[other]
        out.append(cut(at + q, r, s, rank, k))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def side(table: pa.Table, id: str, vector: str, metric: Metric) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The vectors of the greatest length in a table (cosine: as ``units``), their ids and positions."""
    column = table.column(vector).combine_chunks()
    m, ok = matrix(column, int(pc.max(column.value_lengths()).as_py() or 0))
    ids = table.column(id).combine_chunks()
    return units(m) if metric is Metric.COSINE else m, ids if len(ok) == len(ids) else ids.take(pa.array(ok)), ok


def ranks(ids: pa.Array) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def block_pairs(k: int, metric: Metric, exclude_self: bool = False):
    """For cogrouped tables (id, vector) and (other, other_vector): of each id its k best others, by one matrix product a
    slice of ids."""

    def pair(lt: pa.Table, rt: pa.Table) -> pa.Table:
        (m, ids, _), (n, others, _) = side(lt, "id", "vector", metric), side(rt, "other", "other_vector", metric)
        q = r = s = np.zeros(0, np.int64)
        if m.size and n.size and m.shape[1] == n.shape[1]:
            same = None
            if exclude_self:
                known = pc.unique(others)
                same = pc.fill_null(pc.index_in(ids, known), -1).to_numpy(), pc.index_in(others, known).to_numpy()
            q, r, s = nearest(m, n, k, metric, ranks(others), same)
        return pa.table({"query_id": ids.take(pa.array(q, pa.int64())), "id": others.take(pa.array(r, pa.int64())), "score": pa.array(s, pa.float64())})

    return pair


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall,): the share of the exact (query_id, id) rows that were found."""
    hit = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").agg((F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("recall"))
