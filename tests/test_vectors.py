import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomquery.functions import vectors as V
from loomquery.operators import ivf, knn, quantize
from loomquery.schema import Metric


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*x):
    return V.literal(x)


@pytest.mark.parametrize("a,b,want", [((1, 0), (0, 1), 1), ((1, 1), (1, 1), 0), ((1, 0), (-1, 0), 2), ((0, 0), (1, 0), 2), ((1, 2), (1, 2, 3), 2), ((), (), 2)])
def test_cosine(spark, a, b, want):
    assert one(spark, V.cosine_distance(lit(*a), lit(*b))) == pytest.approx(want, abs=1e-9)


def test_kernels(spark):
    assert one(spark, V.dot(lit(1, 2, 3), lit(4, 5, 6))) == 32
    assert one(spark, V.l2_squared(lit(0, 0), lit(3, 4))) == 25
    assert one(spark, V.norm(lit(3, 4))) == 5
    assert one(spark, V.norm(lit())) == 0
    assert one(spark, V.dot(lit(1, 2, 3), lit(1, 2))) < -3e38
    assert one(spark, V.l2_squared(lit(1, 2, 3), lit(1, 2))) > 3e38
    assert one(spark, V.normalize(lit(0, 0))) == [0, 0]
    assert one(spark, V.normalize(lit(3, 4))) == pytest.approx([0.6, 0.8])


def test_scores(spark):
    assert one(spark, V.score(F.lit(1.5), Metric.COSINE)) == 0
    assert one(spark, V.score(F.lit(3.0), Metric.EUCLIDEAN)) == 0.25
    assert one(spark, V.score(F.lit(-2.0), Metric.DOT)) == pytest.approx(1 / (1 + math.exp(-2)))
    assert one(spark, V.score(F.lit(float("nan")), Metric.COSINE)) == 0
    assert one(spark, V.score(F.lit(1e9), Metric.DOT)) == pytest.approx(0, abs=1e-300)


def test_metric_names():
    assert [Metric.parse(x) for x in ("euclidean", "dot", "cosine_distance", "no such", None)] == [Metric.EUCLIDEAN, Metric.DOT, Metric.COSINE, Metric.COSINE, Metric.COSINE]


def rows(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")


def test_knn_orders_and_breaks_ties_by_id(spark):
    table = rows(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)])
    got = knn.exact_knn(table, (1, 0, 0), 3).collect()
    assert [(r["rank"], r.id) for r in got] == [(1, 0), (2, 3), (3, 1)]
    columns = knn.exact_knn_columns(table, (1, 0, 0), 3).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in columns]


def test_knn_skips_other_lengths_and_keeps_zero_queries(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, None), (3, [])], "id long, vector array<float>")
    assert [r.id for r in knn.exact_knn(table, (1, 0), 5).collect()] == [0]
    assert [(r.id, r.score) for r in knn.exact_knn(table, (0, 0), 5).collect()] == [(0, 0.0)]
    assert knn.exact_knn(table.limit(0), (1, 0), 5).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 1000))
def test_batch_join_and_scan_agree(spark, seed):
    import numpy as np

    v = np.random.default_rng(seed).normal(size=(40, 5)).round(3)
    table = rows(spark, v).repartition(3)
    scan = {(r.query_id, r["rank"]): r.id for r in knn.batch_knn(table, [(i, v[i].tolist()) for i in range(40)], 4).collect()}
    join = {(r.query_id, r["rank"]): r.id for r in knn.knn_join(table, table, 4, block_rows=15).collect()}
    assert scan == join


def test_half_and_codes(spark):
    table = rows(spark, [(1, 0), (0, 1), (0.25, 0.5)])
    back = quantize.half_vectors(quantize.to_half(table)).orderBy("id").collect()
    assert [list(r.vector) for r in back] == [[1, 0], [0, 1], [0.25, 0.5]]
    lo, scale = quantize.collected(quantize.calibrate(table))
    assert lo == [0, 0] and scale == pytest.approx([1 / 255] * 2)
    codes = table.select("id", quantize.encode(F.col("vector"), lo, scale).alias("c")).orderBy("id").collect()
    assert [r.c for r in codes] == [[255, 0], [0, 255], [64, 128]]
    constant = rows(spark, [(2, 1), (2, 3)])
    assert quantize.collected(quantize.calibrate(constant)) == ([2, 1], pytest.approx([1, 2 / 255]))
    coded = table.select("id", "vector", quantize.encode(F.col("vector"), lo, scale).alias("code"), V.norm(F.col("vector")).alias("norm"))
    for metric in Metric:
        assert quantize.rerank(coded, (1, 0), 1, lo, scale, metric).first().id == 0


def test_ivf(spark):
    import numpy as np

    v = np.random.default_rng(42).uniform(-1, 1, (64, 8)).tolist()
    table = rows(spark, v + [[0.0] * 8])
    index, placed = ivf.fit(table, k=8)
    exact = [r.id for r in knn.exact_knn(table, v[5], 5).collect()]
    assert [r.id for r in ivf.search(placed, index, v[5], 5, nprobe=8).collect()] == exact
    assert placed.where("cluster = -1").count() == 1
    index, placed = ivf.fit(table, k=8, metric=Metric.EUCLIDEAN)
    assert [r.id for r in ivf.search_bounded(placed, index, v[5], 5).collect()] == [r.id for r in knn.exact_knn(table, v[5], 5, Metric.EUCLIDEAN).collect()]
    for block in (5, 20_000):
        batch = ivf.search_batch(placed, index, table.where("id in (1, 2)"), 3, nprobe=8, block_rows=block)
        want = knn.batch_knn(table, [(1, v[1]), (2, v[2])], 3, Metric.EUCLIDEAN)
        assert knn.recall(batch, want).first()[0] == 1
        assert [tuple(r)[:3] for r in batch.orderBy("query_id", "rank").collect()] == [tuple(r)[:3] for r in want.orderBy("query_id", "rank").collect()]
    assert [ivf.cluster_count(n) for n in (4, 100, 1_000_000)] == [4, 16, 1000]
    assert not ivf.use_index(9_999) and ivf.use_index(10_000)


def test_kmeans_is_fitted_on_all_rows(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(300, 6))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    whole, _ = ivf.fit(table, k=4)
    monkeypatch.setattr(ivf, "FIT_ROWS", 50, raising=False)
    assert np.array_equal(ivf.fit(table, k=4)[0].centroids, whole.centroids)


def test_distances_are_the_same_in_batches_of_any_size():
    import numpy as np

    r = np.random.default_rng(1)
    table, queries = r.normal(1000, 1, (9000, 64)), r.normal(1000, 1, (9, 64))
    exact = ((queries[:, None, :50] - table[None, :, :50]) ** 2).sum(2) + ((queries[:, None, 50:] - table[None, :, 50:]) ** 2).sum(2)
    all_at_once = knn.distances(table, queries, Metric.EUCLIDEAN)
    assert np.abs(all_at_once - exact).max() < 1e-9
    assert np.array_equal(all_at_once[:, 17:19], knn.distances(table[17:19], queries, Metric.EUCLIDEAN)) or np.abs(all_at_once[:, 17:19] - knn.distances(table[17:19], queries, Metric.EUCLIDEAN)).max() < 1e-12


def test_default_probes_reach_the_recall(spark):
    """On vectors without clusters nearly all have to be opened, on well-kept ones few."""
    import numpy as np

    r = np.random.default_rng(3)
    for v, few in ((r.normal(size=(1500, 16)), False), (r.normal(size=(12, 16))[np.arange(1500) % 12] * 20 + r.normal(size=(1500, 16)), True)):
        table = rows(spark, v)
        index, placed = ivf.fit(table, k=24)
        assert (index.probes <= 8) == few
        wanted = table.where("id % 20 = 0")
        assert knn.recall(ivf.search_batch(placed, index, wanted, 10), knn.knn_join(wanted, table, 10)).first()[0] >= 0.9


def test_halves_of_nulls_and_odd_lengths(spark):
    table = spark.createDataFrame([(0, [1.0, -2.5]), (1, None), (2, []), (3, [65504.0, 1e-8, 0.1])], "id long, vector array<float>")
    got = {r.id: r.vector for r in quantize.half_vectors(quantize.to_half(table)).collect()}
    import numpy as np

    assert got == {0: [1.0, -2.5], 1: None, 2: [], 3: [float(x) for x in np.array([65504.0, 1e-8, 0.1], np.float16).astype(np.float32)]}


def _brute(m, n, k, metric, rank, same):
    import numpy as np

    out, s = set(), knn.scores(knn.distances(n, m, metric), metric)
    for q in range(len(m)):
        out |= {(q, r) for _, _, r in sorted((-np.round(s[q, r], 9), rank[r], r) for r in range(len(n)) if same[0][q] != same[1][r])[:k]}
    return out


@pytest.mark.parametrize("metric", list(Metric))
def test_nearest_in_blocks(metric):
    """Exactly the k best by brute force, also of copies, of rows without a direction and where all scores are zero."""
    import numpy as np

    rng = np.random.default_rng(1)
    of = knn.units if metric is Metric.COSINE else lambda x: x
    for nq, nr, d, k in ((20, 1000, 8, 3), (20, 700, 64, 10), (5, 2, 4, 3), (10, 400, 1, 3)):
        for kind in ("random", "copies", "opposite", "zero"):
            m, n = rng.normal(size=(nq, d)), rng.normal(size=(nr, d))
            n = n[rng.integers(0, min(5, nr), nr)] if kind == "copies" else n
            m, n = (abs(m), -abs(n)) if kind == "opposite" else (m, n)
            if kind == "zero":
                n[::2], m[0] = 0, 0
            rank, same = rng.permutation(nr), (np.arange(nq), np.arange(nr) % 50)
            q, r, _ = knn.nearest(of(m), of(n), k, metric, rank, same)
            assert set(zip(q.tolist(), r.tolist())) == _brute(m, n, k, metric, rank, same), kind


def test_copies_give_k_rows_a_query_and_block():
    import pyarrow as pa

    t = lambda n, id, v: pa.table({id: pa.array(range(n), pa.int64()), v: pa.array([[1.0, 2.0]] * n, pa.list_(pa.float32()))})
    found = knn.block_pairs(3, Metric.COSINE, True)(t(4, "id", "vector"), t(3000, "other", "other_vector"))
    assert found.to_pydict()["id"] == [1, 2, 3, 0, 2, 3, 0, 1, 3, 0, 1, 2]


def test_kmeans_on_executors_is_that_on_the_driver(spark, monkeypatch):
    import numpy as np

    table = rows(spark, np.random.default_rng(6).normal(size=(400, 5)))
    for metric in (Metric.COSINE, Metric.EUCLIDEAN):
        one, _ = ivf.fit(table, k=7, metric=metric)
        with monkeypatch.context() as m:
            m.setattr(ivf, "LOCAL_VALUES", 0)
            two, placed = ivf.fit(table, k=7, metric=metric)
        assert np.abs(one.centroids - two.centroids).max() < 1e-9 and one.probes == two.probes and len(one.centroids) == 7


def test_misplaced_rows_are_found(spark):
    table = rows(spark, [[float(i), 0.0] for i in range(40)])
    index, placed = ivf.fit(table, k=4, metric=Metric.EUCLIDEAN)
    assert tuple(ivf.checked(placed, index).first()) == (40, 0, 0)
    other = F.when(F.col("id") == 39, placed.where("id = 0").first().cluster).otherwise(F.col("cluster")).alias("cluster")
    checked = ivf.checked(placed.select("id", "vector", other), index)
    assert tuple(checked.first()) == (40, 1, 1)
    assert "Join" not in checked._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_clusters(spark):
    """Small clusters share blocks, large ones are cut; the answers don't depend on it."""
    import numpy as np

    first, parts, blocks = ivf.laid_out({-1: 2, 0: 5, 1: 25, 2: 3, 3: 10, 4: 4}, 6, 10)
    assert first.tolist() == [0, 0, 1, 4, 5, 6, 6] and parts.tolist() == [1, 1, 3, 1, 1, 1, 1] and blocks == 7
    v = np.random.default_rng(8).normal(size=(240, 5))
    v[100:160] = v[3]
    v[7] = 0
    table = rows(spark, v)
    index, placed = ivf.fit(table, k=6)
    wanted = table.where("id % 20 = 0")
    want = [tuple(r)[:3] for r in knn.knn_join(wanted, table, 4).orderBy("query_id", "rank").collect()]
    for block in (13, 70, 20_000):
        got = ivf.search_batch(placed, index, wanted, 4, nprobe=6, block_rows=block).orderBy("query_id", "rank").collect()
        assert [tuple(r)[:3] for r in got] == want
