"""A search request as one plan: filter, candidate lists, fusion, order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions import vectors as V
from loomquery.functions.attributes import predicate
from loomquery.functions.text import Tokenizer
from loomquery.operators import bm25, fusion, ivf, knn, quantize
from loomquery.schema import Mode, ResolvedRequest, SearchRequest
from loomquery.sources.store import IndexPart, Snapshot


def vector_list(rows: DataFrame, request, n: int) -> DataFrame:
    """(id, score) of the n nearest rows."""
    return knn.top(knn.score_rows(rows, [(0, request.vector)], request.metric, n).select("id", "score"), n).select("id", "score")


def text_list(rows: DataFrame, text: str, n: int, where: Column | None = None, tokenizer: Tokenizer = Tokenizer(), segment: str | None = None) -> DataFrame:
    """(id, score) of the n best BM25 scores."""
    scored = bm25.score(rows, tokenizer.query(text), tokenizer, where, segment).select("id", "score")
    return knn.top(scored, n).select("id", "score")


def probe(part: IndexPart, view: Snapshot, request: SearchRequest, n: int, allowed: Column) -> DataFrame:
    """(id, score) of at least the n nearest visible rows of the clusters that the query opens. Where there are codes, only rows
    whose codes leave it open that they are among the n are scored. The filter comes before the distances."""
    found, query = part.ivf, request.vector
    rows = part.rows.where(F.col("cluster").isin([ivf.CATCH_ALL, *found.nearest(query, request.nprobe)])).where(allowed)
    rows = view.visible(rows.withColumn("segment", F.lit(part.segment)))
    if part.calibration:
        d = quantize.approximate_distance(F.col("code"), query, *part.calibration, found.metric, F.col("norm"))
        error = F.lit(quantize.code_error(part.calibration[1]))
        rows = quantize.possible(rows, *quantize.score_bounds(d, error, query, found.metric, F.col("norm"), True), n)
    elif part.quantization == "f16":
        rows = quantize.half_vectors(rows, "half_vector")
        d = V.distance(F.col("half_vector"), V.literal(query), found.metric)
        error = quantize.half_error(F.col("norm"), len(query))
        rows = quantize.possible(rows, *quantize.score_bounds(d, error, query, found.metric, F.col("norm"), False), n)
    return knn.score_rows(rows.select("id", "vector"), [(0, query)], request.metric, n).select("id", "score")


def index_list(view: Snapshot, request: SearchRequest, n: int, allowed: Column) -> DataFrame | None:
    """(id, score) of the n nearest rows by the inverted files of the segments, with scans of the segments that have none
    and of the log; None if no segment has one of the request's metric."""
    parts, rest = view.index_parts(request.metric)
    if not parts:
        return None
    lists = [probe(p, view, request, n, allowed) for p in parts]
    scans = ([view.stored(rest)] if rest else []) + ([view.fresh()] if view.last is not None else [])
    lists += [knn.score_rows(rows.where(allowed).select("id", "vector"), [(0, request.vector)], request.metric, n).select("id", "score") for rows in scans]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return knn.top(out, n).select("id", "score")


def posting_list(view: Snapshot, request: SearchRequest, n: int, allowed: Column, tokenizer: Tokenizer) -> DataFrame:
    """(id, score) of the n best BM25 scores by the postings of the segments and the texts of the log."""
    terms = tokenizer.query(request.text)
    passing = view.rows().where(allowed).select("id") if request.filters else None
    scored = bm25.score_postings(view.postings(terms, tokenizer), view.text_stats(tokenizer), terms, passing)
    return knn.top(scored, n).select("id", "score")


def fused(plan: ResolvedRequest, vector: DataFrame | None, text: DataFrame | None) -> DataFrame:
    """(rank, id, score) from the lists of a request's mode."""
    if plan.mode is Mode.VECTOR:
        found = knn.top(vector, plan.top_k)
    elif plan.mode is Mode.TEXT:
        found = knn.top(fusion.normalise(text), plan.top_k)
    else:
        found = fusion.fuse(vector, text, plan.top_k, plan.fusion, plan.alpha, plan.rrf_k)
    return found.select("rank", "id", "score")


def _more(rows: DataFrame, request: SearchRequest) -> list[str]:
    return [*(["attributes"] if "attributes" in rows.columns else []), *(["vector"] if request.include_vectors else [])]


def search(rows: DataFrame, request: SearchRequest, dimensions: int | None = None, tokenizer: Tokenizer = Tokenizer(), typed: dict[str, tuple[Column, str]] | None = None, max_top_k: int = 1000) -> DataFrame:
    """(rank, id, score[, attributes][, vector]) of a request over rows (id, vector, text[, attributes][, segment]), of which
    vectors may be null: such rows are found by their text only.

    Statistics of BM25 cover all rows, the filter only what is ranked; each list is cut to its candidates before fusion;
    vectors are read again only where they are asked for.
    """
    plan = request.resolved(dimensions, max_top_k)
    allowed = predicate(request.filters, F.col("attributes") if "attributes" in rows.columns else None, typed)
    vector = vector_list(rows.where(allowed), request, plan.candidates) if plan.mode is not Mode.TEXT else None
    segment = "segment" if request.stats_scope == "segment" and "segment" in rows.columns else None
    text = text_list(rows, request.text, plan.candidates, allowed, tokenizer, segment) if plan.mode is not Mode.VECTOR else None
    found, more = fused(plan, vector, text), _more(rows, request)
    return F.broadcast(found).join(rows.select("id", *more), "id").select("rank", "id", "score", *more).orderBy("rank") if more else found


def search_snapshot(view: Snapshot, request: SearchRequest, tokenizer: Tokenizer = Tokenizer(), max_top_k: int = 1000, cached: DataFrame | None = None) -> DataFrame:
    """(rank, id, score, attributes[, vector]) of a request over a namespace, by its indexes where it has them. cached: the
    view's rows, if they are kept already, for what has no index. The ids found, at most top_k, come to the driver, so
    that their rows are read by Bloom filters and bounds of the segments' files instead of a scan."""
    plan = request.resolved(view.manifest.dimensions, max_top_k)
    allowed = predicate(request.filters, F.col("attributes"))
    rows = view.rows() if cached is None else cached
    vector = text = None
    if plan.mode is not Mode.TEXT:
        vector = index_list(view, request, plan.candidates, allowed)
        vector = vector_list(rows.where(allowed), request, plan.candidates) if vector is None else vector
    if plan.mode is not Mode.VECTOR:
        per_segment = request.stats_scope == "segment"
        if per_segment:
            text = text_list(view.with_segments(), request.text, plan.candidates, allowed, tokenizer, "segment")
        elif view.has_text_index and tokenizer == view.ns.indexing.tokenizer:
            text = posting_list(view, request, plan.candidates, allowed, tokenizer)
        else:
            text = text_list(rows, request.text, plan.candidates, allowed, tokenizer)
    spark = view.spark
    found = fused(plan, vector, text).collect()
    top = spark.createDataFrame(found, "rank int, id string, score double")
    own = rows.where(F.col("id").isin([r.id for r in found])) if found else rows.limit(0)
    return F.broadcast(top).join(own.select("id", *_more(rows, request)), "id").select("rank", "id", "score", *_more(rows, request)).orderBy("rank")
