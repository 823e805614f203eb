"""Inverted-file index: k-means clusters as partitions of the table, and searches that open only the nearest ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions import vectors as V
from loomquery.operators.knn import TILE, batch_knn, cut, distances, exact_knn, matrix, nearest, ranks, side, top, units
from loomquery.schema import Metric

#: Rows below which a scan is better than an index.
LEAST_ROWS = 10_000
#: Vectors without a direction, which cosine clusters can't hold; always opened.
CATCH_ALL = -1


#: Queries and neighbours from which the default of clusters to open is set, and the recall that it has to reach on them.
CALIBRATE_QUERIES, CALIBRATE_K, TARGET_RECALL = 128, 10, 0.95
#: Rows, and queries that open a cluster of theirs, in a block of a search for many.
BLOCK_ROWS = 20_000
#: k-means ends when no centroid moves farther.
TOLERANCE = 1e-4
#: Tables of at most so many numbers come to the driver once for k-means, instead of being read for each of its steps.
LOCAL_VALUES = 1 << 20


@dataclass(frozen=True)
class Ivf:
    """Centroids (cluster, vector, radius) on the driver: about the square root of the rows, at most max_k. probes: how many
    clusters reach TARGET_RECALL on a sample of the rows."""

    centroids: np.ndarray
    radii: np.ndarray
    metric: Metric
    probes: int = 10

    def count(self, nprobe: int | None) -> int:
        """How many clusters to open: those asked for (0: 10), by default those that the recall needs."""
        return min(len(self.centroids), max(1, self.probes if nprobe is None else nprobe or 10))

    def nearest(self, query: Sequence[float], nprobe: int | None = None) -> list[int]:
        """The clusters to open, nearest first."""
        d = distances(self.centroids, np.array([query], np.float64), self.metric)[0]
        return np.argsort(d, kind="stable")[: self.count(nprobe)].tolist()


def cluster_count(rows: int, factor: float = 1.0, least: int = 16, most: int = 65_535) -> int:
    return max(1, min(rows, max(least, min(most, round(rows**0.5 * factor)))))


def use_index(rows: int, enabled: bool = True, least_rows: int = LEAST_ROWS) -> bool:
    return enabled and rows >= least_rows


def assign(vector: Column, centroids: Sequence[Sequence[float]], metric: Metric) -> Column:
    """(distance, cluster) of the nearest of a few centroids, the first among equals."""
    ways = [F.struct(V.distance(vector, V.literal(c), metric).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]
    return F.least(*ways) if len(ways) > 1 else ways[0]


def fit(rows: DataFrame, k: int | None = None, metric: Metric = Metric.COSINE, iterations: int = 25, seed: int = 42) -> tuple[Ivf, DataFrame]:
    """The index, fitted on all rows, and rows (id, vector, ...) with their cluster."""
    usable = rows.where(V.norm(F.col("vector")) > 0) if metric is Metric.COSINE else rows.where(F.size("vector") > 0)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    centroids = _first(usable, k or cluster_count(seen.n), seen.n, seen.d or 0, metric, seed)
    local = rows.select("vector").toArrow() if seen.n * (seen.d or 0) <= LOCAL_VALUES else None
    for _ in range(iterations if len(centroids) > 1 else 1):
        old, centroids = centroids, _moved(rows if local is None else local, centroids, metric)
        if ((centroids - old) ** 2).sum(1).max(initial=0) <= TOLERANCE**2:
            break
    placed = rows.withColumn("cluster", _placing(rows, centroids, metric)("vector"))
    radii = np.zeros(len(centroids))
    for r in placed.where(F.col("cluster") >= 0).select("vector", "cluster").mapInArrow(_furthest(placed, centroids, metric), "cluster int, radius double").groupBy("cluster").agg(F.max("radius").alias("radius")).collect():
        radii[r["cluster"]] = r["radius"]
    index = Ivf(centroids, radii, metric)
    return replace(index, probes=calibrated(placed, index)), placed


def _first(usable: DataFrame, k: int, rows: int, dimensions: int, metric: Metric, seed: int) -> np.ndarray:
    """The rows of smallest hash as centroids; about twice as many as needed are looked at."""
    h = F.xxhash64("id", F.lit(seed))
    some = usable.where(F.size("vector") == dimensions).select(h.alias("h"), "vector")
    few = some.where(F.pmod(h, F.lit(max(1, rows))) < 2 * k + 100).select("h", "vector").orderBy("h").limit(k).collect()
    if len(few) < k:
        few = some.orderBy("h").limit(k).collect()
    out = np.array([r.vector for r in few], np.float64).reshape(len(few), dimensions)
    return units(out) if metric is Metric.COSINE else out


def _own(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row by squared distance, which orders unit vectors as the cosine does; a tile of products
    at a time."""
    half = (centroids**2).sum(1) / 2
    out = np.empty(len(rows), np.int32)
    step = max(1, TILE // len(centroids))
    for at in range(0, len(rows), step):
        out[at : at + step] = (rows[at : at + step] @ centroids.T - half).argmax(1)
    return out


def _usable(column: pa.Array, dimensions: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that clusters can hold (cosine: at unit length), and their positions."""
    rows, ok = matrix(column, dimensions)
    if metric is Metric.COSINE:
        rows = units(rows)
        some = rows.any(1)
        rows, ok = rows[some], ok[some]
    return rows, ok


def _placing(rows: DataFrame, centroids: np.ndarray, metric: Metric):
    """A function of the vector column: the cluster of each row, or CATCH_ALL."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def cluster(vector: pa.Array) -> pa.Array:
        out = np.full(len(vector), CATCH_ALL, np.int32)
        if len(shared.value):
            got, ok = _usable(vector, shared.value.shape[1], metric)
            out[ok] = _own(got, shared.value)
        return pa.array(out)

    return cluster


@dataclass(frozen=True)
class _Held:
    value: np.ndarray


def _moved(rows: DataFrame | pa.Table, centroids: np.ndarray, metric: Metric) -> np.ndarray:
    """The means of the rows nearest to each centroid (cosine: at unit length); one that has none stays. A task gives a sum
    a cluster, which are added up before a row a cluster comes to the driver."""
    local = isinstance(rows, pa.Table)
    shared = _Held(centroids) if local else rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n, total = np.zeros(len(known), np.int64), np.zeros(known.shape)
        for batch in batches:
            got, ok = _usable(batch.column(0), known.shape[1], metric)
            if len(ok):
                own = _own(got, known)
                order = np.argsort(own, kind="stable")
                at, first, count = np.unique(own[order], return_index=True, return_counts=True)
                total[at] += np.add.reduceat(got[order], first)
                n[at] += count
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array([x.tobytes() for x in total[some]], pa.binary())], ["cluster", "n", "total"])

    def added(table: pa.Table) -> pa.Table:
        cluster, n = table.column("cluster").to_numpy(), table.column("n").to_numpy()
        total = np.frombuffer(b"".join(table.column("total").to_pylist())).reshape(len(cluster), -1)
        order = np.argsort(cluster, kind="stable")
        at, first = np.unique(cluster[order], return_index=True)
        return pa.table({"cluster": at, "n": np.add.reduceat(n[order], first), "total": pa.array([x.tobytes() for x in np.add.reduceat(total[order], first)], pa.binary())})

    kinds = "cluster int, n long, total binary"
    parts = max(1, centroids.size * 8 >> 20)
    if not len(centroids):
        return centroids
    if local:
        found = [r for b in sums(iter(rows.to_batches())) for r in zip(*(c.to_pylist() for c in b.columns))]
    else:
        found = rows.select("vector").mapInArrow(sums, kinds).groupBy(F.pmod("cluster", F.lit(parts))).applyInArrow(added, kinds).collect()
        shared.destroy()
    out = centroids.copy()
    for cluster, n, total in found:
        out[cluster] = np.frombuffer(total) / n
    if metric is Metric.COSINE:
        mean = units(out)
        lost = ~mean.any(1)  # rows that cancel out
        mean[lost] = centroids[lost]
        return mean
    return out


def calibrated(placed: DataFrame, index: Ivf, queries: int = CALIBRATE_QUERIES, k: int = CALIBRATE_K, target: float = TARGET_RECALL) -> int:
    """The least number of clusters that hold the share target of the k nearest rows of a bounded sample of the rows (those
    of smallest hash)."""
    sample = placed.where(F.col("cluster") >= 0).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    if not sample:
        return 1
    wanted = [(i, [float(x) for x in r.vector]) for i, r in enumerate(sample)]
    near = F.broadcast(batch_knn(placed, wanted, k, index.metric).select("query_id", "id"))  # k rows a query
    near = placed.select("id", "cluster").join(near, "id").collect()
    order = np.argsort(distances(index.centroids, np.array([v for _, v in wanted]), index.metric), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    at = sorted(int(place[r.query_id, r.cluster]) + 1 for r in near if r.cluster >= 0)
    return at[max(0, int(np.ceil(target * len(at))) - 1)] if at else 1


def _furthest(placed: DataFrame, centroids: np.ndarray, metric: Metric):
    """Of each batch the greatest distance (Euclidean: its root) from its centroid by cluster."""
    shared = placed.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = matrix(batch.column("vector"), shared.value.shape[1])
            if len(ok):
                cluster = batch.column("cluster").to_numpy()[ok]
                own = shared.value[cluster]
                if metric is Metric.EUCLIDEAN:
                    d = np.sqrt(((rows - own) ** 2).sum(1))
                else:
                    dot = (rows * own).sum(1)
                    d = -dot if metric is Metric.DOT else 1 - np.clip(dot / np.sqrt((rows**2).sum(1) * (own**2).sum(1)), -1, 1)
                at = np.unique(cluster)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([d[cluster == c].max() for c in at])], ["cluster", "radius"])

    return run


def checked(placed: DataFrame, index: Ivf) -> DataFrame:
    """(n, misplaced, beyond_radius) of a Euclidean index: rows, those to which another centroid is nearer, and those farther
    from theirs than its radius. A row a batch goes on."""
    shared = placed.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            rows, ok = matrix(batch.column("vector"), found.centroids.shape[1])
            cluster = batch.column("cluster").to_numpy()[ok]
            own = ((rows - found.centroids[cluster]) ** 2).sum(1)
            # the nearest by products, and all that these can't tell from it, by differences
            least, size = own.copy(), (found.centroids**2).sum(1)
            step = max(1, TILE // len(size))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                d = size - 2 * some @ found.centroids.T
                error = 1e-12 * ((some**2).sum(1) + size.max())
                q, c = np.nonzero(d <= (d.min(1) + error)[:, None])
                np.minimum.at(least, at + q, ((some[q] - found.centroids[c]) ** 2).sum(1))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "misplaced": [int((own > least + 1e-9).sum())], "beyond_radius": [int((np.sqrt(own) > found.radii[cluster] + 1e-9).sum())]})

    parts = placed.select("vector", "cluster").mapInArrow(run, "n long, misplaced long, beyond_radius long")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "misplaced", "beyond_radius")])


def write(placed: DataFrame, path: str) -> None:
    """One folder a cluster, so that a search reads only those it opens."""
    placed.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)


def search(placed: DataFrame, index: Ivf, query: Sequence[float], k: int, nprobe: int | None = None) -> DataFrame:
    """(rank, id, score) from the nearest clusters; a filter on the partition column."""
    return exact_knn(placed.where(F.col("cluster").isin([CATCH_ALL, *index.nearest(query, nprobe)])), query, k, index.metric)


def search_bounded(placed: DataFrame, index: Ivf, query: Sequence[float], k: int) -> DataFrame:
    """Exact Euclidean search: the nearest cluster gives a bound, and only clusters whose radius may reach within it
    (triangle inequality) are opened."""
    if index.metric is not Metric.EUCLIDEAN:
        raise ValueError("the bound holds for Euclidean distances")
    reach = np.sqrt(distances(index.centroids, np.array([query], np.float64), index.metric)[0])
    order = np.argsort(reach, kind="stable").tolist()
    worst, opened = None, []
    for n in (1, 4, 16):  # wider first probes until k rows are found
        opened = order[:n]
        first = search(placed.where(F.col("cluster").isin(opened)), index, query, k, len(index.centroids)).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if first["n"] >= k:
            worst = (1 / first["s"] - 1) ** 0.5
            break
    wanted = [c for c in range(len(reach)) if worst is None or reach[c] - index.radii[c] <= worst + 1e-9]
    return exact_knn(placed.where(F.col("cluster").isin(wanted)), query, k, index.metric)


def laid_out(counts: dict[int, int], clusters: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first block of each cluster (CATCH_ALL at 0, the others one further), in how many it is, and how many there are.
    Small clusters share a block, one of more than block_rows rows has several of its own."""
    first, parts, at, held = np.zeros(clusters + 1, np.int64), np.ones(clusters + 1, np.int64), 0, 0
    for c in range(clusters + 1):
        n = counts.get(c - 1, 0)
        if held and held + n > block_rows:
            at, held = at + 1, 0
        first[c], parts[c] = at, max(1, -(-n // block_rows))
        at, held = (at, held + n) if n < block_rows else (at + parts[c], 0)
    return first, parts, int((first + parts).max())


def search_batch(placed: DataFrame, index: Ivf, queries: DataFrame, k: int, nprobe: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score) for a table of queries (id, vector). Clusters are put together, or cut, to blocks of about
    block_rows rows; a query goes once to each block with a cluster that it opens, and meets there the rows of such clusters
    alone, in matrix products that keep k rows a query and block."""
    kind = queries.schema["id"].dataType.simpleString()
    n, clusters = index.count(nprobe), len(index.centroids)
    counts = {r.cluster: r["count"] for r in placed.groupBy("cluster").count().collect()}  # a row a cluster
    first, parts, blocks = laid_out(counts, clusters, block_rows)
    shared = placed.sparkSession.sparkContext.broadcast((index, first, parts))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, first, parts = shared.value
        for batch in batches:
            m, ok = matrix(batch.column("vector"), found.centroids.shape[1])
            step = max(1, TILE // (8 * max(1, clusters)))
            for i in range(0, len(ok), step):
                near = np.argsort(distances(found.centroids, m[i : i + step], found.metric), axis=1, kind="stable")[:, :n]
                opened = np.zeros((len(near), clusters + 1), bool)
                opened[:, 0] = True
                np.put_along_axis(opened, near + 1, True, 1)
                goes = np.zeros((len(near), blocks), bool)
                for c in range(clusters + 1):
                    goes[:, first[c] : first[c] + parts[c]] |= opened[:, c, None]
                to = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(goes.sum(1))), pa.int32()), pa.array(np.nonzero(goes)[1], pa.int32()))
                take = pa.array(ok[i : i + step])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("vector").take(take), pa.array([x.tobytes() for x in np.packbits(opened, axis=1)], pa.binary()), to], ["id", "vector", "opened", "to"])

    def pair(lt: pa.Table, rt: pa.Table) -> pa.Table:
        metric = shared.value[0].metric
        (m, ids, asked), (v, others, held) = side(lt, "id", "vector", metric), side(rt, "other", "other_vector", metric)
        out = []
        if m.size and v.size and m.shape[1] == v.shape[1]:
            opened = np.frombuffer(b"".join(lt.column("opened").to_pylist()), np.uint8).reshape(lt.num_rows, -1)[asked]
            cluster, rank = rt.column("cluster").to_numpy()[held] + 1, ranks(others)
            floor = np.full(len(m), -1.5, np.float32)
            for c in np.unique(cluster):
                own, q = np.flatnonzero(cluster == c), np.flatnonzero(opened[:, c >> 3] >> (7 - (c & 7)) & 1)
                some = floor[q]
                at, row, score = nearest(m[q], v[own], k, metric, rank[own], floor=some)
                floor[q] = some
                out.append((q[at], own[row], score))
        q, r, s = cut(*(np.concatenate(x) for x in zip(*out)), rank, k) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": ids.take(pa.array(q, pa.int64())), "id": others.take(pa.array(r, pa.int64())), "score": pa.array(s, pa.float64())})

    vector = queries.schema["vector"].dataType.simpleString()
    probes = queries.select("id", "vector").mapInArrow(open_, f"id {kind}, vector {vector}, opened binary, to array<int>")
    asked = max(1, -(-queries.count() // block_rows))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    x = probes.select("id", "vector", "opened", part(F.lit(asked)).alias("i"), F.explode("to").alias("j"))
    where = placed.sparkSession.createDataFrame([(c - 1, int(first[c]), int(parts[c])) for c in range(clusters + 1)], "cluster int, first int, parts int")
    y = placed.join(F.broadcast(where), "cluster").select(F.col("id").alias("other"), F.col("vector").alias("other_vector"), "cluster", (F.col("first") + part(F.col("parts"))).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("i"))
    found = x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(pair, f"query_id {kind}, id {placed.schema['id'].dataType.simpleString()}, score double")
    return top(found, k, ["query_id"]).select("query_id", "rank", "id", "score")
