"""The queries over the given tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import vectors as V
from loomquery.functions.attributes import attribute_index, predicate
from loomquery.functions.text import PORTABLE_WORD, STOPWORDS, Tokenizer
from loomquery.operators import bm25, ivf, knn, quantize, versions
from loomquery.plans.catalog import Catalog
from loomquery.plans.search import search
from loomquery.schema import CHANGE, Metric, SearchRequest, duration
from loomquery.sources.scratch import scratch
from loomquery.sources.store import Indexing, Namespace
from loomquery.streaming.ingest import LiveTable, ingest
from loomquery.streaming.writers import BatchedWriter, Compactor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TEXT = "tion thre onesen"


def query(sql: str | None = None, name: str | None = None):
    """Register a query and its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


# tables as the engine's models


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


PERCENTILE_ACCURACY = 1_000_000
#: Scans of at most so many bytes are spread over the cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is a small file of fewer splits than that; what would be costly to move stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those without an embedding are found by their text only."""
    return docs(spark, sf_dir).join(vecs(spark, sf_dir), "id", "left")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), "value", "props")


def vector_of(spark: SparkSession, sf_dir: str, *ids: int) -> list[tuple[int, list[float]]]:
    rows = vecs(spark, sf_dir).where(F.col("id").isin(list(ids))).collect()
    return sorted((r.id, [float(x) for x in r.vector]) for r in rows)


def shown(found: DataFrame, *first: str) -> DataFrame:
    return found.select(*first, "rank", "id", F.round("score", 6).alias("score"))


# nearest neighbours

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_SCORES = {
    Metric.COSINE: "greatest(0e0, 1e0 - (1e0 - least(1e0, greatest(-1e0, list_cosine_similarity(e, q)))))",
    Metric.EUCLIDEAN: "1e0 / (1e0 + list_distance(e, q) * list_distance(e, q))",
    Metric.DOT: "1e0 / (1e0 + exp(-list_dot_product(e, q)))",
}
_RANK = "row_number() OVER ({}ORDER BY round(score, 9) DESC, id)::INTEGER AS rank"


def _top(source: str, k: int, columns: str = "rank, id, round(score, 6) AS score", partition: str = "") -> str:
    return f"SELECT {columns} FROM (SELECT *, {_RANK.format(f'PARTITION BY {partition} ' if partition else '')} FROM ({source})) WHERE rank <= {k}"


def _knn_sql(metric: Metric = Metric.COSINE, where: str = "true", k: int = 10) -> str:
    return f"WITH {_Q}, {_V} " + _top(f"SELECT id, {_SCORES[metric]} AS score FROM v, q WHERE {where}", k)


for _metric, _name in ((Metric.COSINE, "cosine"), (Metric.EUCLIDEAN, "euclidean"), (Metric.DOT, "dot")):

    @query(_knn_sql(_metric), f"knn_{_name}_top10")
    def _knn(spark: SparkSession, sf_dir: str, metric: Metric = _metric) -> DataFrame:
        return shown(knn.exact_knn(vecs(spark, sf_dir), vector_of(spark, sf_dir, 0)[0][1], 10, metric))


@query(_knn_sql())
def knn_columns_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.exact_knn_columns(vecs(spark, sf_dir), vector_of(spark, sf_dir, 0)[0][1], 10))


@query(f"WITH qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), {_V} " + _top(f"SELECT query_id, id, {_SCORES[Metric.COSINE]} AS score FROM v, qs", 5, "query_id, rank, id, round(score, 6) AS score", "query_id"))
def knn_batch_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth row as a query against all rows."""
    rows = vecs(spark, sf_dir)
    return shown(knn.knn_join(rows.where("id % 20 = 0"), rows, 5), "query_id")


_TYPED = {"label": (F.col, "label", "int"), "even": (lambda _: F.col("id") % 2 == 0, "", "boolean")}


def _filtered(filters: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = {k: (f(c), kind) for k, (f, c, kind) in _TYPED.items()}
        rows = vecs(spark, sf_dir).where(predicate(filters, typed=typed))
        return shown(knn.exact_knn(rows, vector_of(spark, sf_dir, 0)[0][1], 10))

    return run


for _name, _filters, _where in (("eq", {"label": 3}, "label = 3"), ("in", {"label": [1, 2, 5]}, "label IN (1, 2, 5)"), ("and", {"label": [1, 2, 5], "even": True}, "label IN (1, 2, 5) AND id % 2 = 0"), ("empty_in", {"label": []}, "false"), ("wrong_type", {"label": ["3", True]}, "false"), ("none", {}, "true")):
    query(_knn_sql(where=_where), f"knn_filter_{_name}")(_filtered(_filters))


@query(f"WITH {_Q}, {_V} SELECT rank, t.id, round(score, 6) AS score, (generate_subscripts(e, 1) - 1)::INTEGER AS dim, round(unnest(e), 6) AS x FROM (" + _top(f"SELECT id, {_SCORES[Metric.COSINE]} AS score FROM v, q", 5, "rank, id, score") + ") t JOIN v ON v.id = t.id")
def knn_include_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest(vector=tuple(vector_of(spark, sf_dir, 0)[0][1]), top_k=5, include_vectors=True)
    found = search(vecs(spark, sf_dir), request)
    each = found.select("rank", "id", F.round("score", 6).alias("score"), F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x"))
    return each.withColumn("x", F.round("x", 6))


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecs(spark, sf_dir).select("id", F.round(V.norm(F.col("vector")), 6).alias("norm"))


@query("SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim, round(unnest(embedding)::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecs(spark, sf_dir).select("id", F.posexplode(V.normalize(F.col("vector"))).alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


@query(f"WITH {_Q}, {_V} SELECT id, round(list_dot_product(e, q), 6) AS dot, round(list_distance(e, q) * list_distance(e, q), 6) AS l2_squared, round(1e0 - list_cosine_similarity(e, q), 6) AS cosine, round({_SCORES[Metric.COSINE]}, 6) AS cosine_score, round({_SCORES[Metric.EUCLIDEAN]}, 6) AS l2_score, round({_SCORES[Metric.DOT]}, 6) AS dot_score FROM v, q")
def metric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = V.literal(vector_of(spark, sf_dir, 0)[0][1]), F.col("vector")
    d = {m: V.distance(v, q, m) for m in Metric}
    got = {"dot": V.dot(v, q), "l2_squared": d[Metric.EUCLIDEAN], "cosine": d[Metric.COSINE], "cosine_score": V.score(d[Metric.COSINE], Metric.COSINE), "l2_score": V.score(d[Metric.EUCLIDEAN], Metric.EUCLIDEAN), "dot_score": V.score(d[Metric.DOT], Metric.DOT)}
    return vecs(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for n, c in got.items()])


@query(f"WITH {_V} " + _top("SELECT a.id AS query_id, b.id AS id, greatest(0e0, 1e0 - (1e0 - list_cosine_similarity(a.e, b.e))) AS score FROM v a JOIN v b ON a.id <> b.id", 3, "query_id, rank, id, round(score, 6) AS score", "query_id"))
def pairwise_topk_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir)
    return shown(knn.knn_join(rows, rows, 3, exclude_self=True), "query_id")


@query(f"WITH {_Q}, {_V} " + _top(f"SELECT (id % 4)::INTEGER AS segment, id, {_SCORES[Metric.COSINE]} AS score FROM v, q", 12, "segment, rank, id, round(score, 6) AS score", "segment"))
def candidate_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir).withColumn("segment", (F.col("id") % 4).cast("int"))
    return shown(knn.segment_candidates(rows, vector_of(spark, sf_dir, 0)[0][1], 2), "segment")


@query(f"WITH {_Q}, {_V} SELECT id, round(1e0 - list_dot_product(e, q) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(q, q)), 6) AS distance FROM v, q")
def cosine_of_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vecs(spark, sf_dir).select("id", V.normalize(F.col("vector")).alias("unit"))
    q = F.broadcast(unit.where("id = 0").select(F.col("unit").alias("q")))
    return unit.crossJoin(q).select("id", F.round(V.cosine_prenormalised(F.col("unit"), F.col("q")), 6).alias("distance"))


# text

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '" + PORTABLE_WORD.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"


def _tokens(text: str = "text") -> str:
    return f"list_filter({_WORDS.format(text)}, lambda x: strlen(x) BETWEEN 2 AND 32 AND x NOT IN ({_STOP}))"


_TOKENS = _tokens()
_DOCS = f"d AS MATERIALIZED (SELECT doc_id AS id, {_TOKENS} AS toks, lang, doc_id % 4 AS segment FROM documents)"
_TF = "tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM d) GROUP BY ALL)"


@query(f"WITH {_DOCS} SELECT id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct FROM d")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("id", Tokenizer().tokens(F.col("text")).alias("t"))
    return rows.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"WITH {_DOCS}, {_TF} SELECT id, term, tf FROM tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_frequency(docs(spark, sf_dir))


@query(f"WITH {_DOCS}, {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequency(docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT id, len(toks)::BIGINT AS dl FROM d")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_lengths(docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT count(*) AS n_docs, sum(len(toks))::BIGINT AS total_len, round(sum(len(toks)) / count(*)::DOUBLE, 6) AS avgdl FROM d")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {_DOCS}, {_TF}, n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, df, round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0), 6) AS idf FROM f, n")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    return bm25.document_frequency(rows).crossJoin(n).select("term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _bm25_rows(text: str = TEXT, where: str = "true", segment: bool = False) -> str:
    terms = Tokenizer().query(text)
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    seg = "segment" if segment else "0"
    return f"""bm AS (SELECT id, sum(times * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (total / n)))) AS score
      FROM (SELECT id, term, count(*)::DOUBLE AS tf, any_value({seg}) AS seg FROM (SELECT id, {seg} AS segment, unnest(toks) AS term FROM d) GROUP BY id, term)
      JOIN (VALUES {values}) w(term, times) USING (term)
      JOIN (SELECT {seg} AS seg, term, count(DISTINCT id)::DOUBLE AS df FROM (SELECT id, {seg} AS segment, unnest(toks) AS term FROM d) GROUP BY 1, 2) USING (seg, term)
      JOIN (SELECT {seg} AS seg, count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE AS total FROM d GROUP BY 1) USING (seg)
      JOIN (SELECT id, len(toks)::DOUBLE AS dl, lang FROM d) USING (id) WHERE {where} GROUP BY id)"""


def _bm25_sql(text: str = TEXT, where: str = "true", segment: bool = False, k: int = 10) -> str:
    return f"WITH {_DOCS}, {_bm25_rows(text, where, segment)} " + _top("SELECT id, score FROM bm", k)


def _bm25(text: str = TEXT, where=None, segment: bool = False, tokenizer: Tokenizer = Tokenizer()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).withColumn("segment", F.col("id") % 4)
        scored = bm25.score(rows, tokenizer.query(text), tokenizer, where() if where else None, "segment" if segment else None)
        return shown(knn.top(scored.select("id", "score"), 10))

    return run


query(_bm25_sql(), "bm25_top10")(_bm25())
query(_bm25_sql(where="lang = 'en'"), "bm25_filtered")(_bm25(where=lambda: F.col("lang") == "en"))
query(_bm25_sql("tion tion thre"), "bm25_duplicate_terms")(_bm25("tion tion thre"))
query(_bm25_sql(segment=True), "bm25_per_segment")(_bm25(segment=True))
query(None, "stemmed_bm25_top10")(_bm25("tions thered onesen", tokenizer=Tokenizer(stem=True)))


@query(_bm25_sql())
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bm25")
    bm25.build_index(docs(spark, sf_dir), path)
    return shown(knn.top(bm25.search_index(spark, path, Tokenizer().query(TEXT)), 10))


@query(_bm25_sql(where="id IN (SELECT vec_id FROM embeddings)"))
def bm25_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked are only ids of another table, statistics cover all documents."""
    path = scratch(spark, "bm25")
    bm25.build_index(docs(spark, sf_dir), path)
    return shown(knn.top(bm25.search_index(spark, path, Tokenizer().query(TEXT), vecs(spark, sf_dir).select("id")), 10))


@query(f"WITH {_DOCS}, {_bm25_rows()}, c AS (" + _top("SELECT id, score FROM bm", 40, "id, score") + ") " + _top("SELECT id, score / (SELECT max(score) FROM c) AS score FROM c", 10))
def text_mode_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search(docs(spark, sf_dir).select("id", "text"), SearchRequest(text=TEXT)))


# fusion


def _lists(where: str = "true") -> str:
    toks = f"d AS MATERIALIZED (SELECT doc_id AS id, {_TOKENS} AS toks, lang, embedding::DOUBLE[] AS e FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"
    return f"""{_Q}, {toks}, {_bm25_rows(where=where)},
      vl AS ({_top(f"SELECT id, {_SCORES[Metric.COSINE]} AS score FROM d, q WHERE e IS NOT NULL AND {where}", 40, "rank, id, score")}),
      tl AS ({_top("SELECT id, score FROM bm", 40, "rank, id, score")})"""


def _blend_sql(alpha: float, where: str = "true") -> str:
    fused = f"SELECT id, {alpha}::DOUBLE * coalesce(v.score / (SELECT nullif(max(score), 0) FROM vl), 0e0) + (1 - {alpha}::DOUBLE) * coalesce(t.score / (SELECT nullif(max(score), 0) FROM tl), 0e0) AS score FROM vl v FULL JOIN tl t USING (id)"
    return f"WITH {_lists(where)} " + _top(fused, 10)


def _rrf_sql(k: int) -> str:
    return f"WITH {_lists()} " + _top(f"SELECT id, coalesce(1e0 / ({k} + v.rank), 0) + coalesce(1e0 / ({k} + t.rank), 0) AS score FROM vl v FULL JOIN tl t USING (id)", 10)


def _hybrid(where=None, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = SearchRequest(vector=tuple(vector_of(spark, sf_dir, 0)[0][1]), text=TEXT, filters=where, **options)
        rows = hybrid(spark, sf_dir).select("id", "vector", "text", "lang")
        return shown(search(rows, request, typed={"lang": (F.col("lang"), "string")}))

    return run


for _name, _alpha in (("default", 0.7), ("alpha0", 0.0), ("alpha1", 1.0), ("half", 0.5)):
    query(_blend_sql(_alpha), f"hybrid_blend_{_name}")(_hybrid(alpha=_alpha))
for _k in (60, 30):
    query(_rrf_sql(_k), f"hybrid_rrf_{_k}")(_hybrid(fusion="rrf", rrf_k=_k))
query(_blend_sql(0.7, "lang = 'en'"), "hybrid_filtered")(_hybrid({"lang": "en"}))


# attributes


@query("SELECT event_id AS id, value FROM events WHERE try_cast(json_extract(props, '$.k') AS DOUBLE) = 7 AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def json_attr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(predicate({"k": 7}, F.col("props"))).select(F.col("event_id").alias("id"), "value")


@query("SELECT event_id AS id, value FROM events WHERE try_cast(json_extract(props, '$.k') AS DOUBLE) IN (1, 2, 3) AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def json_attr_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(predicate({"k": [1, 2.0, 3, "4"]}, F.col("props"))).select(F.col("event_id").alias("id"), "value")


# versions

_LOG = "log AS (SELECT user_id AS id, ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value, props FROM events)"
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS n FROM log) WHERE n = 1)"
_REPLAY = f"WITH {_LOG}, {_LAST} SELECT id, seq, value, props FROM last WHERE op = 'upsert'"


@query(_REPLAY)
def wal_replay_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.replay(log(spark, sf_dir)).select("id", "seq", "value", "props")


@query(f"WITH {_LOG}, {_LAST} SELECT id FROM last WHERE op = 'delete'")
def wal_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.deleted(log(spark, sf_dir))


_SEGMENTS = "seg AS (SELECT user_id AS id, (event_id % 7)::INTEGER AS segment, max(event_id) AS seq FROM events GROUP BY ALL)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), (F.col("event_id") % 7).cast("int").alias("segment")).agg(F.max("event_id").alias("seq"))


@query(f"WITH {_SEGMENTS} SELECT id, segment, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment DESC) AS n FROM seg) WHERE n = 1")
def latest_version_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_segment(_segments(spark, sf_dir))


@query(f"WITH {_LOG}, buf AS (SELECT id, max(seq) AS seq FROM log WHERE seq % 10 = 0 GROUP BY id), seg AS (SELECT id, max(seq) AS seq FROM log WHERE seq % 10 <> 0 GROUP BY id) SELECT id, seq FROM buf UNION ALL SELECT id, seq FROM seg WHERE id NOT IN (SELECT id FROM buf) AND id % 11 <> 0")
def buffer_overrides_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    newest = lambda side: side.groupBy("id").agg(F.max("seq").alias("seq"))
    buffer = newest(rows.where("seq % 10 = 0"))
    return versions.overlay(newest(rows.where("seq % 10 <> 0")), buffer, rows.where("id % 11 = 0").select("id").distinct())


@query(f"WITH {_LOG}, {_LAST} SELECT id, seq FROM last WHERE id NOT IN (SELECT id FROM log WHERE id % 5 = 0)")
def tombstone_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return versions.without_tombstones(versions.latest_change(rows), rows.where("id % 5 = 0").select("id").distinct()).select("id", "seq")


@query(f"WITH {_LOG}, {_LAST} SELECT id FROM (SELECT id FROM log WHERE id % 5 = 0 UNION SELECT id FROM last WHERE op = 'delete') EXCEPT SELECT id FROM last WHERE op = 'upsert'")
def tombstone_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return versions.merge_tombstones(rows.where("id % 5 = 0").select("id").distinct(), rows)


@query(f"""WITH {_LOG}, lives AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS life FROM log),
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM lives) WHERE n = 1 AND op = 'upsert')
  SELECT cur.id, min(l.seq) AS born, any_value(cur.seq) AS seq FROM cur JOIN lives l ON l.id = cur.id AND l.life = cur.life AND l.op = 'upsert' GROUP BY cur.id ORDER BY born DESC LIMIT 50""")
def fifo_buffer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.fifo(log(spark, sf_dir), 50)


@query(f"WITH {_SEGMENTS} SELECT count(*) AS approx_count, count(DISTINCT id) AS distinct_ids, count(DISTINCT segment) AS segments, (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 5 = 0) AS tombstones FROM seg")
def namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    gone = F.broadcast(read(spark, sf_dir, "events").where("user_id % 5 = 0").agg(F.countDistinct("user_id").alias("tombstones")))
    return seg.agg(F.count("*").alias("approx_count"), F.countDistinct("id").alias("distinct_ids"), F.countDistinct("segment").alias("segments")).crossJoin(gone)


@query("SELECT count(*) AS wal_entries, count(DISTINCT ts::DATE) AS wal_days, count(*) FILTER (event_type = 'error') AS deletes, max(ts) AS last_ts FROM events")
def compaction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(F.count("*").alias("wal_entries"), F.countDistinct(F.to_date("ts")).alias("wal_days"), F.count_if(F.col("event_type") == "error").alias("deletes"), F.max("ts").alias("last_ts"))


@query("WITH m AS (SELECT event_id AS id, sha256(props) AS content_hash FROM events) SELECT id FROM (SELECT * FROM m EXCEPT SELECT * FROM m WHERE id % 3 <> 0)")
def segment_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.sha2("props", 256).alias("content_hash"))
    return versions.sync_diff(manifest, manifest.where("id % 3 <> 0")).select("id")


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.9), 6) AS p90, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sketches of bounded size: exact up to PERCENTILE_ACCURACY values of a group, then within 1/PERCENTILE_ACCURACY of
    the rank."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile_approx("value", p / 100, PERCENTILE_ACCURACY), 6).alias(f"p{p}") for p in (50, 90, 95, 99)])


@query("SELECT vec_id::VARCHAR AS id, (CASE WHEN vec_id < 50 THEN 'new' ELSE 'old' END) AS text FROM embeddings WHERE vec_id % 10 <> 0 OR vec_id < 50")
def namespace_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert, delete and compact, then upsert again: the rows a search sees."""
    ns = Namespace(spark, scratch(spark, "catalog"), "vectors")
    rows = vecs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.lit("old").alias("text"))
    ns.upsert(rows, 1)
    ns.delete(rows.where(F.col("id").cast("long") % 10 == 0), 2)
    ns.compact()
    ns.upsert(rows.where(F.col("id").cast("long") < 50).withColumn("text", F.lit("new")), 3)
    return ns.live().select("id", "text")


@query(_knn_sql().replace("SELECT id, greatest", "SELECT id::VARCHAR AS id, greatest"))
def namespace_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace with an IVF index and 8-bit codes, all clusters opened: the rows of an exact scan."""
    root = scratch(spark, "catalog")
    catalog = Catalog(spark, root)
    ns = catalog.namespace("vectors")
    ns.upsert(vecs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector"), 1)
    ns.compact()
    ns.build_index(least_rows=1)
    return shown(catalog.search("vectors", SearchRequest(tuple(vector_of(spark, sf_dir, 0)[0][1]), nprobe=1 << 16)))


# all documents and embeddings as one namespace: text where there is a document, a short vector where there is no embedding
_LIVE = "live AS MATERIALIZED (SELECT id::VARCHAR AS id, CASE WHEN id % 50 = 1 THEN 'tion thre' ELSE text END AS text, e, id % 50 = 1 AS new FROM (SELECT coalesce(vec_id, doc_id) AS id, text, embedding::DOUBLE[] AS e FROM documents FULL JOIN embeddings ON doc_id = vec_id) WHERE id % 10 <> 0)"
_LIVE_DOCS = f"{_LIVE}, d AS MATERIALIZED (SELECT id, {_TOKENS} AS toks, e, new, 'x' AS lang FROM live)"


def _filled(spark: SparkSession, sf_dir: str, indexing: Indexing, table: LiveTable | None = None) -> tuple[Catalog, Namespace]:
    """A namespace of two segments with deletes, and changes after them: in the log, or in a live table."""
    catalog = Catalog(spark, scratch(spark, "catalog"), indexing=indexing)
    if table is not None:
        catalog.attach("all", table)
    ns = catalog.namespace("all")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    width = e.select(F.size("vector")).first()[0]
    none = F.array(*[F.lit(0.0).cast("float")] * width)
    rows = d.join(e, "id", "full").select(F.col("id").cast("string").alias("id"), F.coalesce("vector", none).alias("vector"), "text", F.when(F.col("id") % 50 == 1, '{"new": true}').otherwise('{"new": false}').alias("attributes"))
    number = F.col("id").cast("long")
    ns.upsert(rows.withColumn("text", F.when(number % 3 == 0, "stale words").otherwise(F.col("text"))), 1)
    ns.compact()
    ns.upsert(rows.where(number % 3 == 0), 2)
    ns.delete(rows.where(number % 20 == 0), 3)
    ns.compact()
    fresh = rows.where(number % 50 == 1).withColumn("text", F.lit("tion thre"))
    gone = rows.where(number % 20 == 10)
    if table is None:
        ns.upsert(fresh, 4)
        ns.delete(gone, 5)
    else:
        new = fresh.withColumn("op", F.lit("upsert")).unionByName(gone.select("id", *[F.lit(None).cast(CHANGE[c].dataType).alias(c) for c in ("vector", "text", "attributes")]).withColumn("op", F.lit("delete")))
        table.merge(new.select(F.lit(4).cast("long").alias("ts"), F.monotonically_increasing_id().alias("seq"), "op", "id", "vector", "text", "attributes"), 0)
    return catalog, ns


@query(f"WITH {_LIVE_DOCS}, {_bm25_rows()}, c AS (" + _top("SELECT id, score FROM bm", 40, "id, score") + ") " + _top("SELECT id, score / (SELECT max(score) FROM c) AS score FROM c", 10))
def namespace_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 by the postings of the segments, without replaced and deleted rows, and the texts of the log."""
    catalog, _ = _filled(spark, sf_dir, Indexing(least_rows=1 << 60))
    return shown(catalog.search("all", SearchRequest(text=TEXT)))


@query(f"WITH {_LIVE_DOCS}, {_bm25_rows().replace('lang FROM d', 'lang, new FROM d').replace('WHERE true', 'WHERE NOT new')}, c AS (" + _top("SELECT id, score FROM bm", 40, "id, score") + ") " + _top("SELECT id, score / (SELECT max(score) FROM c) AS score FROM c", 10))
def namespace_text_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a filter on attributes, after the statistics; the changes are in a live table."""
    table = LiveTable(spark, scratch(spark, "live"), CHANGE)
    catalog, _ = _filled(spark, sf_dir, Indexing(least_rows=1 << 60), table)
    return shown(catalog.search("all", SearchRequest(text=TEXT, filters={"new": False})))


def _namespace_lists(alpha: float) -> str:
    score = f"CASE WHEN e IS NULL THEN 0e0 ELSE {_SCORES[Metric.COSINE]} END"
    lists = f"{_Q}, {_LIVE_DOCS}, {_bm25_rows()}, vl AS ({_top(f'SELECT id, {score} AS score FROM d, q', 40, 'rank, id, score')}), tl AS ({_top('SELECT id, score FROM bm', 40, 'rank, id, score')})"
    fused = f"SELECT id, {alpha}::DOUBLE * coalesce(v.score / (SELECT nullif(max(score), 0) FROM vl), 0e0) + (1 - {alpha}::DOUBLE) * coalesce(t.score / (SELECT nullif(max(score), 0) FROM tl), 0e0) AS score FROM vl v FULL JOIN tl t USING (id)"
    return f"WITH {lists} " + _top(fused, 10)


for _kind in ("sq8", "f16", "none"):

    @query(_namespace_lists(0.7), f"namespace_hybrid_{_kind}")
    def _namespace_hybrid(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        """Both lists by the indexes that compaction wrote, all clusters opened, with the log."""
        catalog, _ = _filled(spark, sf_dir, Indexing(quantization=kind, least_rows=1, clusters=16))
        return shown(catalog.search("all", SearchRequest(tuple(vector_of(spark, sf_dir, 0)[0][1]), TEXT, nprobe=1 << 16)))


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 2 = 0 THEN 'late' ELSE 'first' END AS text FROM embeddings UNION ALL SELECT 'lost writers: ' || 2, NULL")
def namespace_concurrent_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two compactors at once, one that began with an old manifest, and a writer in flight: no row is lost, the losers fail."""
    root = scratch(spark, "catalog")
    a, b = Namespace(spark, root, "n"), Namespace(spark, root, "n")
    rows = vecs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.lit("first").alias("text"))
    a.upsert(rows, 1)
    old = b.manifest()
    lost = 0
    with a._writing(old):  # a is at work, b comes
        try:
            b.compact()
        except RuntimeError:
            lost += 1
    a.compact()
    try:
        b._commit(old.__class__(1))
    except RuntimeError:
        lost += 1
    # a log folder without _SUCCESS is still being written
    late = rows.where(F.col("id").cast("long") % 2 == 0).withColumn("text", F.lit("late"))
    a.upsert(late, 2)
    folder = a.log_files()[0]
    a.files.rename(f"{folder}/_SUCCESS", f"{folder}/_later")
    b.compact()
    a.files.rename(f"{folder}/_later", f"{folder}/_SUCCESS")
    b.compact()
    return b.live().select("id", "text").unionByName(spark.createDataFrame([(f"lost writers: {lost}", None)], "id string, text string"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 4 = 0) AS gone FROM embeddings)
  SELECT * FROM (SELECT 1::BIGINT AS generation, n AS live, n AS approx_count, 1 AS segments, 0::BIGINT AS tombstones FROM n UNION ALL SELECT 2, n - gone, n, 1, gone FROM n UNION ALL SELECT 3, n - gone, n - gone, 1, 0 FROM n UNION ALL SELECT 4, n, n, 2, 0 FROM n)""")
def namespace_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generation as it was: loaded, a quarter deleted, folded, the quarter upserted again."""
    ns = Namespace(spark, scratch(spark, "catalog"), "n")
    rows = vecs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector")
    quarter = rows.where(F.col("id").cast("long") % 4 == 0)
    ns.upsert(rows, 1)
    ns.compact()
    ns.delete(quarter, 2)
    ns.compact()
    ns.fold()
    ns.upsert(quarter, 3)
    ns.compact()
    out = []
    for g in ns.generations():
        m = ns.manifest(g)
        out.append((g, ns.live(g).count(), sum(s.doc_count for s in m.segments), len(m.segments), ns.tombstones(m).count()))
    return spark.createDataFrame(out, "generation long, live long, approx_count long, segments int, tombstones long")


@query("""WITH v AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 5 = 0) AS gone, any_value(len(embedding)) AS d FROM embeddings)
  SELECT 'big' AS namespace, n AS approx_count, d::INTEGER AS dimensions, false AS pending, 1 AS wal_files, gone AS wal_entries, 1 AS segments, n AS distinct_ids, n - gone AS live, false AS warming FROM v
  UNION ALL SELECT 'new', 0, NULL, true, 1, gone, 0, 0, gone, false FROM v""")
def namespace_info_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing, info, status and statistics of the namespaces of an allow-list; 'hidden' isn't on it."""
    root = scratch(spark, "catalog")
    rows = vecs(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector")
    fifth = rows.where(F.col("id").cast("long") % 5 == 0)
    Catalog(spark, root).namespace("hidden").upsert(fifth, 1)
    catalog = Catalog(spark, root, allowed=["big", "new"])
    catalog.namespace("big").upsert(rows, 1)
    catalog.namespace("big").compact()
    catalog.namespace("big").delete(fifth, 2)
    catalog.namespace("new").upsert(fifth, 1)
    out = []
    for info in catalog.infos():
        name = info["namespace"]
        status, stats = catalog.namespace(name).status(), catalog.stats(name)
        out.append((name, info["approx_count"], info["dimensions"], info["pending_compaction"], status["wal_files"], status["wal_entries"], status["segments"], stats["distinct_ids"], stats["live"], stats["warming"]))
    return spark.createDataFrame(out, "namespace string, approx_count long, dimensions int, pending boolean, wal_files int, wal_entries long, segments int, distinct_ids long, live long, warming boolean")


@query("SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT 'rounds with a commit: 2'")
def namespace_batched_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single changes through the batching writer, compacted at intervals: three batches, of which the last stays in the log."""
    ns = Namespace(spark, scratch(spark, "catalog"), "n")
    writer, compactor = BatchedWriter(ns, most=1 << 30, interval="1h"), Compactor(ns, "5m")
    rows = vecs(spark, sf_dir)
    ns.upsert(rows.select(F.col("id").cast("string").alias("id"), "vector"), 1)
    done = [compactor.run_once()]
    acks = [writer.delete(str(r.id)) for r in rows.where("id % 3 = 0").select("id").toLocalIterator()]
    writer.flush()
    done += [compactor.run_once(), compactor.run_once()]
    acks += [writer.upsert(str(r.id), [float(x) for x in r.vector]) for r in rows.where("id % 300 = 1").toLocalIterator()]
    writer.close()
    if not all(a.done() and a.exception() is None for a in acks):
        raise RuntimeError("a change wasn't acknowledged")
    return ns.live().select("id").unionByName(spark.createDataFrame([(f"rounds with a commit: {sum(done)}",)], "id string"))


@query("SELECT id, seq, value FROM (SELECT user_id AS id, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, event_type, ts FROM events) WHERE n = 1 AND event_type <> 'error' AND epoch_us(ts) > (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM events)")
def buffer_trimmed_by_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live table after a compaction took all changes up to a time: newer ones stay, tombstones are pruned with theirs."""
    changes = log(spark, sf_dir).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    table = LiveTable(spark, scratch(spark, "live"), changes.schema)
    table.merge(changes.where("seq % 2 = 0"), 0)
    table.merge(changes.where("seq % 2 = 1"), 1)
    lo, hi = changes.agg(F.min("ts"), F.max("ts")).first()
    table.trim(lo + (hi - lo) // 2)
    return table.rows().select("id", "seq", "value")


_CASES = [
    (None, "x", None, None, None, "Euclidean"), ([1.0], None, None, "rrf", 0, "dot"), ([1.0], "x", None, "RRF", 5, "cosine"), ([1.0], "x", "text", None, 5000, "unknown"), ([1.0], " ", "vector", "blend", -3, "dot_product"),
    ([1.0], None, "hybrid", None, 10, None), (None, None, None, None, 10, ""), ([1.0], "x", "other", None, 10, "euclidean_squared"), ([float("nan")], None, None, None, 10, "cosine"), ([1.0], "x", "hybrid", "sum", 12, "COSINE"),
]


def _case_sql() -> str:
    def lit(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    rows = ", ".join(f"({i}, {'true' if v else 'false'}, {'true' if v and v[0] == v[0] else 'false'}, {lit(t)}, {lit(m)}, {lit(f)}, {lit(k)}, {lit(d)})" for i, (v, t, m, f, k, d) in enumerate(_CASES))
    mode = "CASE WHEN mode IS NOT NULL THEN mode WHEN has_v AND has_t THEN 'hybrid' WHEN has_t THEN 'text' ELSE 'vector' END"
    ok = "m IN ('text', 'vector', 'hybrid') AND (m = 'text' OR has_v) AND (m = 'vector' OR has_t) AND (finite OR NOT has_v)"
    return f"""WITH c(n, has_v, finite, text, mode, fusion, k, metric) AS (VALUES {rows}), r AS (SELECT *, trim(coalesce(text, '')) <> '' AS has_t FROM c), s AS (SELECT *, {mode} AS m, CASE WHEN coalesce(k, 0) <= 0 THEN 10 WHEN k > 1000 THEN 1000 ELSE k END AS top FROM r)
      SELECT n::INTEGER AS n, CASE WHEN {ok} THEN m END AS mode, CASE WHEN {ok} THEN CASE WHEN lower(coalesce(fusion, '')) = 'rrf' THEN 'rrf' ELSE 'blend' END END AS fusion, CASE WHEN {ok} THEN top::INTEGER END AS top_k, CASE WHEN {ok} THEN greatest(4 * top, top + 10)::INTEGER END AS candidates,
        CASE WHEN lower(coalesce(metric, '')) IN ('euclidean', 'euclidean_squared') THEN 'euclidean_squared' WHEN lower(coalesce(metric, '')) IN ('dot', 'dot_product') THEN 'dot_product' ELSE 'cosine' END AS metric FROM s"""


@query(_case_sql())
def request_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, fusion, k, candidates and metric of requests; nulls where a request can't be answered."""
    out = []
    for n, (v, t, m, f, k, d) in enumerate(_CASES):
        request = SearchRequest(tuple(v) if v else None, t, mode=m, fusion=f, top_k=k, distance_metric=d)
        try:
            r = request.resolved()
            out.append((n, r.mode.value, r.fusion.value, r.top_k, r.candidates, request.metric.value))
        except ValueError:
            out.append((n, None, None, None, None, request.metric.value))
    return spark.createDataFrame(out, "n int, mode string, fusion string, top_k int, candidates int, metric string")


@query("SELECT * FROM (VALUES ('300', 300e0), ('5m', 300e0), ('1h30m', 5400e0), ('1.5s', 1.5e0), ('250ms', 0.25e0)) t(text, seconds)")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, duration(t)) for t in ("300", "5m", "1h30m", "1.5s", "250ms")], "text string, seconds double")


@query("SELECT key, value, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, unnest(json_extract(props, '$.*'))::VARCHAR AS value FROM events) WHERE value <> 'null' AND left(value, 1) NOT IN ('[', '{') GROUP BY ALL")
def attribute_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_index(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("attributes")))


# streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return raw.select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), "value", "props")


@query(_REPLAY)
def streaming_lww_matches_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = LiveTable(spark, scratch(spark, "live"), log(spark, sf_dir).schema)
    ingest(_stream(spark, sf_dir), table, scratch(spark, "offsets")).awaitTermination()
    return table.rows().select("id", "seq", "value", "props")


@query("SELECT date_trunc('hour', ts) AS start, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, count(*) AS n FROM events GROUP BY ALL")
def streaming_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomquery.streaming.ingest import windowed_changes

    path = scratch(spark, "counts")
    changes = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_changes(changes).withColumn("start", F.col("start").cast("timestamp_ntz"))
    # update mode: the watermark bounds the state, and a batch writes only the windows that it changed
    out = counts.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    out.option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("start", "op").agg(F.max_by("n", "batch").alias("n"))


# quantization and inverted files

_CAL = "cal AS MATERIALIZED (SELECT dim, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1e0 END AS sc FROM (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY dim)"
_CODES = "codes AS MATERIALIZED (SELECT id, x.dim, greatest(0, least(255, round((x - lo) / sc)))::INTEGER AS code FROM (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) x JOIN cal USING (dim))"


@query(f"WITH {_CAL} SELECT dim::INTEGER AS dim, round(lo, 9) AS min, round(sc, 9) AS scale FROM cal")
def sq8_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.calibrate(vecs(spark, sf_dir)).select("dim", F.round("min", 9).alias("min"), F.round("scale", 9).alias("scale"))


@query(f"WITH {_CAL}, {_CODES} SELECT id, dim::INTEGER AS dim, code FROM codes")
def sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir)
    ranges = quantize.collected(quantize.calibrate(rows))
    return rows.select("id", F.posexplode(quantize.encode(F.col("vector"), *ranges)).alias("dim", "code"))


@query(f"""WITH {_Q}, {_V}, {_CAL}, {_CODES}, qd AS (SELECT generate_subscripts(q, 1) - 1 AS dim, unnest(q) AS x, sqrt(list_dot_product(q, q)) AS len FROM q),
  ap AS (SELECT codes.id, sum(qd.x * (lo + sc * code)) / (any_value(sqrt(list_dot_product(e, e))) * any_value(qd.len)) - 1e0 AS score FROM codes JOIN cal USING (dim) JOIN qd USING (dim) JOIN v ON v.id = codes.id GROUP BY codes.id),
  few AS ({_top("SELECT id, score FROM ap", 40, "id")}) """ + _top(f"SELECT id, {_SCORES[Metric.COSINE]} AS score FROM few JOIN v USING (id), q", 10))
def sq8_topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir)
    ranges = quantize.collected(quantize.calibrate(rows))
    coded = rows.select("id", "vector", quantize.encode(F.col("vector"), *ranges).alias("code"), V.norm(F.col("vector")).alias("norm"))
    return shown(quantize.rerank(coded, vector_of(spark, sf_dir, 0)[0][1], 10, *ranges))


#: The nearest half: multiples of 2**(exponent - 10), ties to even; below 2**-14 multiples of 2**-24.
_HALF = "list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0e0 ELSE round_even(x / pow(2e0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2e0, greatest(floor(log2(abs(x))), -14) - 10) END)"


@query(f"WITH {_Q}, v AS (SELECT vec_id AS id, {_HALF} AS e FROM embeddings) " + _top(f"SELECT id, {_SCORES[Metric.COSINE]} AS score FROM v, q", 10))
def f16_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = quantize.half_vectors(quantize.to_half(vecs(spark, sf_dir)))
    return shown(knn.exact_knn(half, vector_of(spark, sf_dir, 0)[0][1], 10))


@query(_knn_sql())
def ivf_full_probe_equals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, placed = ivf.fit(vecs(spark, sf_dir).select("id", "vector"))
    return shown(ivf.search(placed, index, vector_of(spark, sf_dir, 0)[0][1], 10, nprobe=len(index.centroids)))


@query(_knn_sql(Metric.EUCLIDEAN))
def ivf_triangle_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, placed = ivf.fit(vecs(spark, sf_dir).select("id", "vector"), metric=Metric.EUCLIDEAN)
    return shown(ivf.search_bounded(placed, index, vector_of(spark, sf_dir, 0)[0][1], 10))


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS recall_reached FROM embeddings")
def ivf_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate search for every twentieth row against all rows, by the clusters that the index opens by default: whether
    it finds nine tenths of what brute force finds."""
    rows = vecs(spark, sf_dir).select("id", "vector")
    wanted = rows.where("id % 20 = 0")
    index, placed = ivf.fit(rows)
    found = knn.recall(ivf.search_batch(placed, index, wanted, 10), knn.knn_join(wanted, rows, 10))
    return found.crossJoin(wanted.agg(F.count("*").alias("queries"))).select("queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("SELECT count(*) AS n, greatest(16, round(sqrt(count(*))))::INTEGER AS clusters, 0::BIGINT AS misplaced, 0::BIGINT AS beyond_radius FROM embeddings")
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means over all rows: how many clusters, rows that another centroid is nearer to, rows beyond their cluster's radius."""
    index, placed = ivf.fit(vecs(spark, sf_dir).select("id", "vector"), metric=Metric.EUCLIDEAN)
    return ivf.checked(placed, index).select("n", F.lit(len(index.centroids)).alias("clusters"), "misplaced", "beyond_radius")


_MEANS = "means AS MATERIALIZED (SELECT label AS cluster, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"
_ASSIGN = f"{_MEANS}, near AS (SELECT id, cluster, d FROM (SELECT id, cluster, list_distance(e, c) * list_distance(e, c) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(e, c), cluster) AS n FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), means) WHERE n = 1)"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir)
    means = rows.select("label", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("c")).orderBy("label").collect()
    labels = F.array(*[F.lit(r.label) for r in centroids])
    near = ivf.assign(F.col("vector"), [r.c for r in centroids], Metric.EUCLIDEAN)
    return rows.select("id", near.alias("near")).select("id", F.element_at(labels, F.col("near.cluster") + 1).alias("cluster"), F.col("near.distance").alias("distance"))


@query(f"WITH {_ASSIGN} SELECT id, cluster, round(d, 6) AS distance FROM near")
def centroid_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_ASSIGN} SELECT cluster, count(*) AS n, round(max(sqrt(d)), 6) AS radius FROM near GROUP BY cluster")
def cluster_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.max(F.sqrt("distance")), 6).alias("radius"))
