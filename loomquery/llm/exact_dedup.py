"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its last bytes says so, hence copies are cut alike wherever they stand.
A chunk becomes an identifier: the leading bits of its hash, verified by its SHA-256 digest over the whole corpus.
Identifiers whose chunks don't all have one digest are replaced by the digest itself in the recipes that hold them.
Two texts are copies if their recipes, the ordered identifiers with the length, are equal. Only identifiers and
digests (about 2 % of the text) are ever shuffled; a text is read once and never moves.

Defined cases: null texts are copies of nothing and stay; empty texts are copies of one another; the row of the
smallest ``doc_id`` of a group is its original; rows with a null ``doc_id`` are originals only of groups that have
no other, and those of a group with another row go; of rows repeated with one doc_id and text one stays, and ties go to
the smallest id; an empty table has no copies; a very long text is cut whole, in one block of about 30 bytes a byte; other
columns, whatever their names, play no part and are kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import fresh, lists, map_text, materialise, possible, read, sized, small, text_key

#: Bytes under the rolling hash; a cut where its low bits are zero: one in 2**CUT_BITS bytes.
WINDOW, CUT_BITS = 32, 11
LEAST_CHUNK, MOST_CHUNK = 512, 16384
HASH_BITS = 64


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    sums = K.prefix_sums(np.frombuffer(data, np.uint8))
    rolled = K.span(sums, np.arange(n - WINDOW + 1), np.arange(WINDOW, n + 1))
    out, last = [], 0
    for at in (np.flatnonzero(rolled & np.uint64((1 << CUT_BITS) - 1) == 0) + WINDOW).tolist():
        while at - last > MOST_CHUNK:
            last += MOST_CHUNK
            out.append(last)
        if at - last >= LEAST_CHUNK:
            out.append(at)
            last = at
    while n - last > MOST_CHUNK:
        last += MOST_CHUNK
        out.append(last)
    if last < n:
        out.append(n)
    return out


def recipes(docs: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """(doc_id, key, n_bytes, ids, digests) of every row that has a text; ids are the first hash_bits of the hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keep = (1 << hash_bits) - 1

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests, edges, size = [], [], [0], []
        for text in part.column("text").cast(pa.binary()).to_pylist():
            last = 0
            for at in cuts(text):
                piece = text[last:at]
                ids.append(xxhash.xxh3_64_intdigest(piece) & keep)
                digests.append(hashlib.sha256(piece).digest())
                last = at
            edges.append(len(ids))
            size.append(len(text))
        edges = np.array(edges)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("key"), pa.array(size, pa.int64()), lists(edges, np.array(ids, np.uint64).view(np.int64), pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(digests, pa.binary()))],
            ["doc_id", "key", "n_bytes", "ids", "digests"],
        )

    rows = docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return map_text(rows, run, f"doc_id {kind}, key long, n_bytes long, ids array<long>, digests array<binary>")


def verified(made: DataFrame) -> DataFrame:
    """Recipes with ``wide``: null, or the digests where an identifier stands for several different chunks."""
    chunks = made.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests")
    shared = materialise(chunks.distinct().groupBy("ids").count().where("count > 1").select(F.col("ids").alias("id")), "collisions")
    if shared.isEmpty():
        return made.withColumn("wide", F.lit(None).cast("array<binary>"))
    hit = made.select("doc_id", "key", "n_bytes", F.explode("ids").alias("id")).join(sized(shared, 8), "id", "left_semi").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("n_bytes").alias("b")).distinct()
    same = made["doc_id"].eqNullSafe(hit["d"]) & (made["key"] == hit["k"]) & (made["n_bytes"] == hit["b"])
    return made.join(hit, same, "left").select(made["*"], F.when(hit["k"].isNotNull(), made["digests"]).alias("wide"))


def groups(docs: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """(doc_id, key, keep_id, n): each different doc_id and text of a group of equal recipes, with the group's smallest
    doc_id and the count of rows of that doc_id and text; only groups of several rows."""
    made = materialise(recipes(docs, hash_bits), "recipes")
    rows = verified(made).groupBy("ids", "n_bytes", "wide", "doc_id", "key").agg(F.count("*").alias("n"))
    rows = materialise(rows, "recipe-rows")
    firsts = rows.groupBy("ids", "n_bytes", "wide").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("rows")).where("rows > 1")
    a, b = rows.alias("a"), firsts.alias("b")
    same = (F.col("a.ids") == F.col("b.ids")) & (F.col("a.n_bytes") == F.col("b.n_bytes")) & F.col("a.wide").eqNullSafe(F.col("b.wide"))
    return a.join(b, same).select("a.doc_id", "a.key", "b.keep_id", "a.n")


def copies(docs: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """(doc_id, dup_of): every document that is a copy of one of smaller doc_id, and the smallest such."""
    return groups(docs, hash_bits).where("doc_id <> keep_id").select("doc_id", F.col("keep_id").alias("dup_of")).distinct()


def deduplicate(docs: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """docs with one row of each group of copies."""
    found = materialise(groups(docs, hash_bits), "copies")
    names = docs.columns
    key, maybe, d, k = fresh(docs, "text_key"), fresh(docs, "maybe_copy"), "drop_id", "drop_key"
    while {d, k} & {c.lower() for c in names}:
        d, k = "_" + d, "_" + k
    keyed = docs.withColumn(key, text_key(F.col("text")))

    def rows(which: DataFrame, how: str) -> DataFrame:
        side = materialise(which.select(F.col("doc_id").alias(d), F.col("key").alias(k)).distinct(), "copy-keys")
        same = lambda of, other: of.join(other, of["doc_id"].eqNullSafe(other[d]) & (of[key] == other[k]), how)
        n = side.count()
        if small(n, 24):
            return same(keyed, F.broadcast(side))
        # texts whose key isn't among them don't move
        marked = keyed.withColumn(maybe, possible(F.col(key), side.select(k), n))
        met = same(marked.where(maybe), side)
        return (met if how == "left_semi" else met.unionByName(marked.where(~F.col(maybe)))).drop(maybe)

    gone = found.where("not doc_id <=> keep_id")
    again = found.where("doc_id <=> keep_id and n > 1")
    if again.isEmpty():
        return rows(gone, "left_anti").select(names)
    once = rows(again, "left_semi").dropDuplicates(["doc_id", key])
    keyed_rest = gone.unionByName(again)
    return rows(keyed_rest, "left_anti").unionByName(once).select(names)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(read(spark, sf_dir, "documents"))


ORACLE = """
SELECT DISTINCT doc_id, dup_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of FROM documents WHERE text IS NOT NULL
) WHERE doc_id <> dup_of"""
