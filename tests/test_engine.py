import pytest
from pyspark.sql import functions as F

from loomquery.functions.attributes import predicate
from loomquery.operators import versions
from loomquery.plans.catalog import Catalog
from loomquery.plans.search import search
from loomquery.schema import CHANGE, Mode, SearchRequest, duration
from loomquery.sources.scratch import scratch
from loomquery.sources.store import Indexing, Manifest, Namespace
from loomquery.streaming.ingest import LiveTable, expire, ingest
from loomquery.streaming.writers import BatchedWriter, Compactor

ATTRS = [(0, '{"k": 1}'), (1, '{"k": "1"}'), (2, '{"k": 1.0, "b": true}'), (3, '{"k": null}'), (4, '{"k": {"y": [1], "x": 2}}'), (5, "{}"), (6, None), (7, "no json"), (8, '{"b": "true"}')]


@pytest.mark.parametrize("filters,want", [({"k": 1}, [0, 2]), ({"k": "1"}, [1]), ({"b": True}, [2]), ({"k": ["1", 1]}, [0, 1, 2]), ({"k": []}, []), ({"k": None}, [3]), ({"k": [{"x": 2, "y": [1]}]}, [4]), ({"k": 1, "b": True}, [2]), ({"absent": 1}, []), ({}, list(range(9))), (None, list(range(9)))])
def test_filters(spark, filters, want):
    rows = spark.createDataFrame(ATTRS, "id long, attributes string")
    assert sorted(r.id for r in rows.where(predicate(filters, F.col("attributes"))).collect()) == want


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") % 3).alias("label")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = rows.where(predicate({"label": 2}, typed={"label": (F.col("label"), "int")}))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,2)" in plan


def test_requests():
    v = (1.0, 0.0)
    assert SearchRequest(v).resolved().mode is Mode.VECTOR
    assert SearchRequest(v, "x").resolved().mode is Mode.HYBRID
    assert SearchRequest(text="x").resolved().mode is Mode.TEXT
    assert SearchRequest(v, top_k=0).resolved().top_k == 10
    assert SearchRequest(v, top_k=5000).resolved().top_k == 1000
    assert SearchRequest(v, alpha=7).resolved().alpha == 1
    assert SearchRequest(v, top_k=2).resolved().candidates == 12
    for bad in (SearchRequest(), SearchRequest(v, mode="text"), SearchRequest(text="x", mode="hybrid"), SearchRequest(v, mode="other"), SearchRequest((float("nan"),))):
        with pytest.raises(ValueError):
            bad.resolved()
    with pytest.raises(ValueError):
        SearchRequest(v).resolved(dimensions=3)


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>, text string, attributes string")


PAIR = [("a", [1.0, 0.0], "hello world", '{"tag": "x"}'), ("b", [0.0, 1.0], "goodbye rust", '{"tag": "y"}')]


def test_search(spark):
    rows = docs(spark, PAIR)
    got = search(rows, SearchRequest((1.0, 0.0), top_k=1, filters={"tag": "x"})).collect()
    assert [(r.id, r.attributes) for r in got] == [("a", '{"tag": "x"}')]
    assert [r.id for r in search(rows, SearchRequest(text="hello", top_k=1)).collect()] == ["a"]
    assert search(rows, SearchRequest(text="the of")).collect() == []
    assert search(rows, SearchRequest((1.0, 0.0), text="rust", include_vectors=True, fusion="rrf")).columns == ["rank", "id", "score", "attributes", "vector"]


def log(spark, rows):
    return spark.createDataFrame([(ts, seq, op, i, [1.0, float(x)] if op == "upsert" else None, None, None) for ts, seq, op, i, x in rows], CHANGE)


CHANGES = [(1, 0, "upsert", "a", 1), (2, 1, "delete", "a", 0), (3, 2, "upsert", "a", 2), (1, 3, "upsert", "b", 1), (4, 4, "delete", "b", 0), (1, 5, "upsert", "c", 1), (1, 6, "upsert", "c", 9), (0, 7, "upsert", "c", 5)]


def test_replay_tombstones_and_idempotence(spark):
    changes = log(spark, CHANGES)
    live = {r.id: r.vector[1] for r in versions.replay(changes).collect()}
    assert live == {"a": 2, "c": 9}
    assert {r.id: r.vector[1] for r in versions.replay(changes.unionByName(changes)).collect()} == live
    assert [r.id for r in versions.deleted(changes).collect()] == ["b"]
    stones = spark.createDataFrame([("a",), ("z",)], "id string")
    assert sorted(r.id for r in versions.merge_tombstones(stones, changes).collect()) == ["b", "z"]


def test_fifo(spark):
    changes = log(spark, [(0, 0, "upsert", "a", 1), (0, 1, "upsert", "b", 1), (0, 2, "upsert", "a", 2), (0, 3, "upsert", "c", 1), (0, 4, "delete", "b", 0), (0, 5, "upsert", "b", 1)])
    assert sorted(r.id for r in versions.fifo(changes, 2).collect()) == ["b", "c"]


def test_namespace_lifecycle(spark, tmp_path):
    ns = Namespace(spark, str(tmp_path), "one")
    assert ns.live().collect() == [] and not ns.info()["pending_compaction"]
    ns.upsert(docs(spark, PAIR), 1000)
    assert ns.info()["pending_compaction"] and ns.status()["wal_entries"] == 2
    assert sorted(r.id for r in ns.live().collect()) == ["a", "b"]
    first = ns.compact()
    assert first.generation == 1 and first.dimensions == 2 and ns.status()["wal_files"] == 0
    ns.delete(spark.createDataFrame([("b",), ("none",)], "id string"), 2000)
    ns.upsert(docs(spark, [("a", [0.5, 0.5], "new", None)]), 3000)
    assert [(r.id, r.text) for r in ns.live().collect()] == [("a", "new")]
    second = ns.compact()
    assert [(r.id, r.text) for r in ns.live().collect()] == [("a", "new")]
    assert second.generation == 2 and ns.info()["approx_count"] == 3
    assert sorted(r.id for r in ns.tombstones().collect()) == ["b", "none"]
    assert sorted(r.id for r in ns.live(generation=1).collect()) == ["a", "b"]
    ns.upsert(docs(spark, [PAIR[1]]), 4000)
    ns.compact()
    assert sorted(r.id for r in ns.live().collect()) == ["a", "b"]
    assert ns.compact().generation == 3
    folded = ns.fold()
    assert len(folded.segments) == 1 and folded.segments[0].doc_count == 2 and ns.tombstones().collect() == []
    assert sorted((r.id, r.text) for r in ns.live().collect()) == [("a", "new"), ("b", "goodbye rust")]
    assert sorted(r.id for r in ns.live(generation=1).collect()) == ["a", "b"]
    for bad in ([("x", [1.0], None, None)], [("x", [], None, None)], [("x", None, None, None)], [("x", [float("nan"), 1.0], None, None)], [(None, [1.0, 2.0], None, None)], []):
        with pytest.raises(ValueError):
            ns.upsert(docs(spark, bad))
    with pytest.raises(ValueError):
        ns.delete(spark.createDataFrame([], "id string"))


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), most_cached=1)
    for name in ("alpha", "beta"):
        c.namespace(name).upsert(docs(spark, PAIR), 1)
        assert [r.id for r in c.search(name, SearchRequest((1.0, 0.0), top_k=1)).collect()] == ["a"]
    assert c.active() == ["beta"] and c.list() == ["alpha", "beta"]
    request = SearchRequest((1.0, 0.0), top_k=1)
    assert [r.id for r in c.search_cached("beta", request).collect()] == ["a"]
    c.namespace("beta").delete(spark.createDataFrame([("a",)], "id string"), 2)
    assert [r.id for r in c.search_cached("beta", request).collect()] == ["b"]
    assert c.stats("beta")["live"] == 1
    with pytest.raises(KeyError):
        Catalog(spark, str(tmp_path), allowed=["alpha"]).namespace("beta")


def test_stream_equals_batch(spark, tmp_path):
    changes = log(spark, CHANGES)
    for i in range(4):  # out of order over several files
        changes.where(F.col("seq") % 4 == 3 - i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = LiveTable(spark, str(tmp_path / "table"), CHANGE)
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, table, str(tmp_path / "offsets")).awaitTermination()
    want = sorted((r.id, r.seq) for r in versions.replay(changes).collect())
    assert sorted((r.id, r.seq) for r in table.rows().collect()) == want
    before = table.version()
    table.merge(changes, before)  # a batch run again
    assert table.version() == before
    assert [r.id for r in expire(table, 3).collect()] == ["b"]
    table.compact()
    assert table.version() == before and sorted((r.id, r.seq) for r in table.rows().collect()) == want
    late = log(spark, [(2, 9, "upsert", "b", 3), (9, 10, "delete", "a", 0)])
    table.merge(late, before + 1)
    assert [r.id for r in table.rows().collect()] == ["c"]


@pytest.mark.parametrize("quantization", ["sq8", "f16", "none"])
def test_indexed_namespace(spark, tmp_path, quantization):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(300, 6)).round(4)
    rows = [(f"{i:03d}", v[i].tolist(), None, f'{{"k": {i % 3}}}') for i in range(300)]
    catalog = Catalog(spark, str(tmp_path))
    ns = catalog.namespace("n")
    ns.upsert(docs(spark, rows), 1)
    assert not ns.build_index()
    ns.compact()
    assert not ns.build_index() and all(x.index is None for x in ns.manifest().segments)
    request = SearchRequest(tuple(v[7].tolist()), top_k=5, nprobe=99, filters={"k": [0, 1]})
    plain = [(r["rank"], r.id) for r in catalog.search("n", request).collect()]
    assert ns.build_index(quantization=quantization, least_rows=10, clusters=8)
    assert [(r["rank"], r.id) for r in catalog.search("n", request).collect()] == plain
    ns.delete(spark.createDataFrame([(plain[0][1],)], "id string"), 2)
    ns.upsert(docs(spark, [("299", v[7].tolist(), None, '{"k": 1}')]), 3)
    got = [r.id for r in catalog.search("n", request).collect()]
    assert got == ["299"] + [i for _, i in plain[1:5] if i != "299"]
    few = SearchRequest(tuple(v[7].tolist()), top_k=5, nprobe=1)
    assert len(catalog.search("n", few).collect()) == 5
    with pytest.raises(RuntimeError):
        ns._commit(ns.manifest())


def test_two_compactors_and_a_writer_in_flight(spark, tmp_path):
    a, b = Namespace(spark, str(tmp_path), "n"), Namespace(spark, str(tmp_path), "n")
    a.upsert(docs(spark, [(f"{i}", [float(i), 1.0], None, None) for i in range(10)]), 1)
    old = a.manifest()
    with a._writing(old), pytest.raises(RuntimeError):
        b.compact()
    # both begin; the second to publish fails and removes what it wrote
    with pytest.raises(RuntimeError), b._writing(old) as folder:
        spark.range(3).write.parquet(folder("segment"))
        b.files.delete(f"{b.path}/claims/1")  # its claim went stale
        a.compact()
        b._commit(Manifest(1))
    assert sum(n.startswith("segment-") for n in a.files.list(f"{a.path}/data")) == 1
    assert a.live().count() == 10 and a.manifest().generation == 1
    a.upsert(docs(spark, [("late", [1.0, 1.0], None, None)]), 2)
    folder = a.log_files()[0]
    a.files.rename(f"{folder}/_SUCCESS", f"{folder}/_later")
    assert a.compact().generation == 1 and a.live().count() == 10 and a.files.exists(folder)
    a.files.rename(f"{folder}/_later", f"{folder}/_SUCCESS")
    assert a.live().count() == 11 and a.compact().generation == 2 and a.live().count() == 11


def test_log_folders_outlive_their_readers(spark, tmp_path):
    ns = Namespace(spark, str(tmp_path), "n")
    ns.upsert(docs(spark, PAIR), 1)
    before = ns.live()
    ns.compact()
    assert before.count() == 2  # planned before, read after
    assert ns.log_files() == [] and len(ns.files.list(f"{ns.path}/wal")) == 1
    ns.delete(spark.createDataFrame([("a",)], "id string"), 2)
    ns.compact()
    assert [r.id for r in ns.live().collect()] == ["b"] and len(ns.files.list(f"{ns.path}/wal")) == 1
    assert ns.vacuum(1) == [1] and [r.id for r in ns.live().collect()] == ["b"] and ns.generations() == [2]


def test_searches_read_the_indexes(spark, tmp_path):
    """The plan of a vector search opens only the folders of its clusters; text search pushes the terms."""
    import numpy as np

    v = np.random.default_rng(2).normal(size=(400, 6)).round(4)
    rows = [(f"{i:03d}", v[i].tolist(), f"word{i % 40} common", f'{{"k": {i % 3}}}') for i in range(400)]
    catalog = Catalog(spark, str(tmp_path), indexing=Indexing(least_rows=10, clusters=16))
    ns = catalog.namespace("n")
    ns.upsert(docs(spark, rows), 1)
    ns.compact()
    assert all(s.index and s.text for s in ns.manifest().segments)
    view = ns.snapshot()
    from loomquery.plans.search import index_list, posting_list

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = index_list(view, SearchRequest(tuple(v[3].tolist()), nprobe=2), 14, F.lit(True))
    assert "PartitionFilters: [cluster" in plan(few) and "segment-" not in "".join(few.inputFiles())
    text = posting_list(view, SearchRequest(text="word7"), 14, F.lit(True), catalog.tokenizer)
    assert "In(term, [word7])" in plan(text) or "EqualTo(term,word7)" in plan(text)
    ns.upsert(docs(spark, [("003", v[9].tolist(), "word7 word7", '{"k": 9}')]), 2)
    ns.compact()
    assert len(ns.manifest().segments) == 2 and ns.manifest().dead_docs == 1
    for request in (SearchRequest(text="word7 common", top_k=3), SearchRequest(tuple(v[9].tolist()), top_k=3), SearchRequest(tuple(v[9].tolist()), "word7", top_k=3, filters={"k": [0, 9]}), SearchRequest(text="word7", top_k=3, stats_scope="segment")):
        got = [(r["rank"], r.id, round(r.score, 9)) for r in catalog.search("n", request).collect()]
        plain = [(r["rank"], r.id, round(r.score, 9)) for r in search(ns.snapshot().with_segments(), request).collect()]
        assert got == plain, request


def test_live_table_is_searched_with_its_namespace(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    table = LiveTable(spark, str(tmp_path) + "-live", CHANGE)
    catalog.attach("n", table)
    ns = catalog.namespace("n")
    ns.upsert(docs(spark, PAIR), 5)
    ns.compact()
    table.merge(spark.createDataFrame([(6, 0, "upsert", "c", [1.0, 0.0], "hello again", None), (7, 1, "delete", "a", None, None, None), (4, 2, "upsert", "b", [9.0, 9.0], "older than the compaction", None)], CHANGE), 0)
    assert [r.id for r in catalog.search("n", SearchRequest((1.0, 0.0), top_k=2)).collect()] == ["c", "b"]
    assert [r.id for r in catalog.search("n", SearchRequest(text="hello older")).collect()] == ["c"]
    assert len(table) == 3
    table.trim(5)
    assert sorted(r.id for r in table.changes().collect()) == ["a", "c"] and table.version() == 0
    table.merge(spark.createDataFrame([(8, 3, "upsert", "d", [1.0, 0.0], None, None)], CHANGE), 1)
    assert sorted(r.id for r in table.rows().collect()) == ["c", "d"]
    assert catalog.stats("n")["warming"] is False


def test_batched_writer(spark, tmp_path):
    ns = Namespace(spark, str(tmp_path), "n")
    w = BatchedWriter(ns, most=3, interval="1h")
    acks = [w.upsert("a", [1.0, 2.0]), w.upsert("a", [3.0, 4.0])]
    assert not any(a.done() for a in acks) and ns.log_files() == []
    assert isinstance(w.upsert("x", [float("nan")]).exception(), ValueError)
    acks.append(w.delete("b"))
    assert all(a.result() is None for a in acks) and len(ns.log_files()) == 1
    assert [list(r.vector) for r in ns.live().collect()] == [[3.0, 4.0]]
    timed = BatchedWriter(ns, most=99, interval=0.2)
    assert timed.upsert("c", [1.0, 1.0]).result(30) is None and len(ns.log_files()) == 2


def test_compactor(spark, tmp_path):
    import time

    ns = Namespace(spark, str(tmp_path), "n")
    ns.upsert(docs(spark, PAIR), 1)
    seen = []
    c = Compactor(ns, "50ms", after=lambda: seen.append(1)).start()
    end = time.time() + 60
    while time.time() < end and c.rounds < 2:
        time.sleep(0.05)
    c.stop()
    assert ns.manifest().generation == 1 and seen == [1] and c.errors == []


def test_durations():
    assert [duration(x) for x in ("90", "1.5s", "2m 30s", "1h", "250ms")] == [90, 1.5, 150, 3600, 0.25]
    for bad in ("", "5 apples", "m5"):
        with pytest.raises(ValueError):
            duration(bad)


def test_filter_keys_with_quotes(spark):
    rows = spark.createDataFrame([(1, '{"it\'s": 3, "a\\"b": 4, "a.b": 5}')], "id long, attributes string")
    for key, value in (("it's", 3), ('a"b', 4), ("a.b", 5)):
        assert rows.where(predicate({key: value}, F.col("attributes"))).count() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch(Session, "x")


@pytest.mark.parametrize("quantization", ["sq8", "f16"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_codes_lose_no_near_copy(spark, tmp_path, quantization, metric):
    """With all clusters opened the rows of a scan, though codes can't tell hundreds of near copies apart."""
    import numpy as np

    rng = np.random.default_rng(4)
    q = rng.normal(size=8)
    v = np.concatenate([q + rng.normal(size=(400, 8)) * 1e-4, rng.normal(size=(100, 8)), [[90.0] * 8, [-90.0] * 8]])
    catalog = Catalog(spark, str(tmp_path))
    ns = catalog.namespace("n")
    ns.upsert(docs(spark, [(f"{i:03d}", x.tolist(), None, None) for i, x in enumerate(v)]), 1)
    ns.compact()
    request = SearchRequest(tuple(q.tolist()), top_k=5, nprobe=99, distance_metric=metric)
    assert ns.build_index(metric=request.metric, quantization=quantization, least_rows=10, clusters=4)
    plain = search(ns.live(), request)
    assert [r.id for r in catalog.search("n", request).collect()] == [r.id for r in plain.orderBy("rank").collect()]


def test_compaction_moves_rows_once(spark):
    """The last change of each id is found by the sort that a segment needs: one exchange, no aggregate of whole rows."""
    log = spark.createDataFrame([(1, "f", 0, "upsert", "a", [1.0], "old", None), (2, "f", 0, "upsert", "a", [2.0], "new", None), (2, "f", 1, "delete", "b", None, None, None), (1, "f", 1, "upsert", "b", [3.0], "x", None)], "ts long, file string, seq long, op string, id string, vector array<float>, text string, attributes string")
    made = Namespace._by_id(log, True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and plan.count("+- Sort") + plan.count("- Sort [") > 0
    assert [(r.id, r.text) for r in made.collect()] == [("a", "new")]
