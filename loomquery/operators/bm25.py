"""BM25 over a table (id, text [, segment]): term statistics, an index, and scored search.

A search without an index doesn't explode the texts: it counts only the query's terms, a document a row, so the only
exchange is that of the statistics. Statistics cover all rows, texts or not, before any filter.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.text import Tokenizer, stemmed
from loomquery.sources.files import Files

K1, B = 1.2, 0.75


def token_rows(docs: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(id, term), a row a token."""
    if not tokenizer.stem:
        return docs.select("id", F.explode(tokenizer.tokens(F.col("text"))).alias("term"))
    return stemmed(docs.select("id", F.explode(tokenizer.words(F.col("text"))).alias("term")), "term", tokenizer)


def term_frequency(docs: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(id, term, tf): the postings."""
    return token_rows(docs, tokenizer).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(term, df); texts are cut to their different words before they are exploded."""
    if tokenizer.stem:
        return term_frequency(docs, tokenizer).groupBy("term").agg(F.count("*").alias("df"))
    words = docs.select(F.explode(F.array_distinct(tokenizer.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(docs: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(id, dl), rows without text included."""
    if tokenizer.stem:
        counted = token_rows(docs, tokenizer).groupBy("id").agg(F.count("*").alias("n"))
        return docs.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("dl"))
    return docs.select("id", F.size(tokenizer.tokens(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(n_docs, total_len, avgdl): avgdl is 1 where there are no tokens."""
    return total_stats(doc_lengths(docs, tokenizer))


def total_stats(lengths: DataFrame) -> DataFrame:
    out = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
    return out.withColumn("avgdl", average_length(F.col("total_len"), F.col("n_docs")))


def average_length(total: Column, n: Column) -> Column:
    mean = total / F.nullif(n, F.lit(0)).cast("double")
    return F.when(mean > 0, mean).otherwise(F.lit(1.0))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _count(tokens: Column, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def score(docs: DataFrame, terms: list[str], tokenizer: Tokenizer = Tokenizer(), where: Column | None = None, segment: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score[, segment]) of the documents that hold a term; a term that the query repeats counts as often.
    where filters after the statistics; segment: statistics of each segment by itself."""
    counts = Counter(terms)
    keep = [segment] if segment else []
    if not counts:
        return docs.limit(0).select("id", F.lit(0.0).alias("score"), *keep)
    flag = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    names = [f"tf{i}" for i in range(len(counts))]
    if tokenizer.stem:
        held = token_rows(docs, tokenizer)
        per = held.groupBy("id").agg(F.count("*").alias("dl"), *[F.count_if(F.col("term") == t).alias(c) for c, t in zip(names, counts)])
        rows = docs.select("id", flag.alias("ok"), *keep).join(per, "id", "left").na.fill(0, ["dl", *names])
        found = rows.where("ok")
    else:

        def counted(some: DataFrame) -> DataFrame:
            tokens = some.select("id", *keep, tokenizer.tokens(F.col("text")).alias("tokens"))
            return tokens.select("id", *keep, F.size("tokens").alias("dl"), *[_count(F.col("tokens"), t).alias(c) for c, t in zip(names, counts)])

        rows = counted(docs)
        # for what is ranked, only texts that hold a term as a string are cut into tokens
        holds = reduce(lambda x, y: x | y, [F.contains(F.lower("text"), F.lit(t)) for t in counts])
        found = counted(docs.where(flag & holds))
    stats = rows.groupBy(*keep).agg(F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.count_if(F.col(c) > 0).alias("df" + c) for c in names])
    hits = found.where(reduce(lambda x, y: x | y, [F.col(c) > 0 for c in names]))
    joined = hits.join(F.broadcast(stats), segment) if segment else hits.crossJoin(F.broadcast(stats))
    avgdl = average_length(F.col("total"), F.col("n"))
    parts = [times * idf(F.col("n"), F.col("df" + c)) * weight(F.col(c), F.col("dl"), avgdl, k1, b) for c, times in zip(names, counts.values())]
    return joined.select("id", reduce(lambda x, y: x + y, parts).alias("score"), *keep)


def counted(tokens: pa.Array) -> pa.Array:
    """Of each list its different words, with how often it holds them."""
    n = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    many = max(1, len(words.dictionary))
    key, tf = np.unique(np.repeat(np.arange(len(n), dtype=np.int64), n) * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(key % many)), pa.array(tf, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(n) + 1, dtype=np.int64) * many), pa.int32()), pairs)


def counts(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(id, dl, counts): a row a document of unique id, its words with their counts; a text is cut into words once and no
    word is shuffled."""

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def of(tokens: pa.Array) -> pa.Array:
        return counted(tokens)

    tokens = docs.select("id", tokenizer.tokens(F.col("text")).alias("tokens")).select("id", of("tokens").alias("counts"))
    return tokens.select("id", F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda n, c: n + c["tf"]), F.lit(0)).alias("dl"), "counts")


def _exploded(counted: DataFrame) -> DataFrame:
    return counted.select("id", "dl", F.inline("counts"))


def postings(docs: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(id, dl, term, tf): postings that carry the document's length, so that a search joins nothing of the corpus's size."""
    if tokenizer.stem:
        return term_frequency(docs, tokenizer).join(doc_lengths(docs, tokenizer), "id").select("id", "dl", "term", "tf")
    return _exploded(counts(docs, tokenizer))


def build_index(docs: DataFrame, path: str, tokenizer: Tokenizer = Tokenizer()) -> int:
    """Write postings (sorted by term, so that a term's row groups are found by their bounds), lengths and statistics; the
    tokens of all documents. The counts of the documents are written first and go at the end: finding the bounds of the
    terms reads them once more than sorting does."""
    spark, beside = docs.sparkSession, f"{path}/_counts"
    if tokenizer.stem:
        listed, lengths = postings(docs, tokenizer), doc_lengths(docs, tokenizer)
    else:
        counts(docs, tokenizer).write.mode("overwrite").parquet(beside)
        held = spark.read.parquet(beside)
        listed, lengths = _exploded(held), held.select("id", "dl")
    listed.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    Files(spark).delete(beside)
    lengths = spark.read.parquet(f"{path}/lengths")
    total_stats(lengths).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return spark.read.parquet(f"{path}/stats").first()["total_len"]


def score_postings(listed: DataFrame, stats: DataFrame, terms: list[str], allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) from the postings (id, dl, term, tf) of the terms in all documents and their statistics (n_docs,
    total_len, avgdl). allowed: (id) to keep, after the statistics."""
    asked = Counter(terms)
    df = listed.groupBy("term").agg(F.count("*").alias("df"))  # a row a term of the query
    times = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in asked.items()], F.lit(0)) if asked else F.lit(0)
    if allowed is not None:
        listed = listed.join(allowed, "id", "left_semi")
    rows = listed.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    part = times * idf(F.col("n_docs"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def search_index(spark, path: str, terms: list[str], allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) from a written index; the terms are pushed to the scan of the postings. allowed: (id) to keep."""
    wanted = F.col("term").isin(list(dict.fromkeys(terms))) if terms else F.lit(False)
    return score_postings(spark.read.parquet(f"{path}/postings").where(wanted), spark.read.parquet(f"{path}/stats"), terms, allowed, k1, b)
