"""Spark helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.sources.scratch import scratch

#: Characters of text that a kernel handles at once; longer texts are a block of their own.
BLOCK_CHARS = 1 << 18
#: A side of a join is broadcast only if it was counted and is estimated to be at most this large.
BROADCAST_BYTES = 32 << 20
#: What a row takes in a broadcast table besides its values, and what an id takes.
ROW_BYTES, ID_BYTES = 32, 16
#: Bits of a filter: at most 32 MB.
MOST_BITS = 1 << 28


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(n: int, row_bytes: int) -> bool:
    """Whether n rows of so many bytes of values may be broadcast; a hash table takes ROW_BYTES a row besides."""
    return n * (ROW_BYTES + row_bytes) <= BROADCAST_BYTES


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are small; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if small(df.count(), row_bytes) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


class Bloom:
    """A filter of at most ``MOST_BITS`` bits, whatever the number of keys: 64-bit hashes that it holds always pass, of
    others few (1.4 % at 16 bits a key, more where the bound makes them fewer)."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words).bit_length() + 5

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> Bloom:
        """Of the one column of hashes, about n different ones; the bits are gathered by words, at most 4 M of them."""
        bits = int(min(MOST_BITS, max(1 << 10, 16 * n))).bit_length() - 1
        h = F.col(hashes.columns[0])
        places = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits))).alias("at"))
        word = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word")
        got = places.groupBy(F.shiftright("at", 6).alias("i")).agg(word).toArrow()
        words = np.zeros(1 << bits - 6, np.uint64)
        words[got.column("i").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
        return cls(words)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be among the keys."""
        out = np.ones(len(h), bool)
        for at in (h & np.uint64((1 << self.bits) - 1), h >> np.uint64(64 - self.bits)):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def possible(key: Column, known: DataFrame, n: int) -> Column:
    """Whether a key may be among those known (one column of the key's type, n rows); only hashes go to Python."""
    shared = known.sparkSession.sparkContext.broadcast(Bloom.of(known.select(F.xxhash64(F.col(known.columns[0]))), n))

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.holds(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return test(F.xxhash64(key))


def meeting(rows: DataFrame, side: DataFrame, on: str, row_bytes: int) -> DataFrame:
    """rows joined with side, a row a key. Where side is too large to be broadcast, a filter of bounded size goes before
    the shuffle, so that hardly any rows move that meet nothing."""
    n = side.count()
    if small(n, row_bytes):
        return rows.join(F.broadcast(side), on)
    return rows.where(possible(F.col(on), side.select(on), n)).join(side, on)


def within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (one column); filtered before a shuffle as in ``meeting``."""
    key = fresh(docs, "some_id")
    n, side = ids.count(), ids.select(F.col(ids.columns[0]).cast(docs.schema["doc_id"].dataType).alias(key))
    if small(n, ID_BYTES):
        return docs.join(F.broadcast(side), docs["doc_id"] == side[key], "left_semi")
    some = docs.where(possible(F.col("doc_id"), side, n))
    return some.join(side, some["doc_id"] == side[key], "left_semi")


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in drop (one column, doc_id); null ids stay. Texts of rows that a filter of
    bounded size clears don't move."""
    key = fresh(docs, "drop_id")
    n, side = drop.count(), drop.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(key))
    if small(n, ID_BYTES):
        return docs.join(F.broadcast(side), docs["doc_id"] == side[key], "left_anti")
    maybe = fresh(docs, "maybe")
    marked = docs.withColumn(maybe, possible(F.col("doc_id"), side, n))
    rest = marked.where(F.col(maybe)).drop(maybe)
    return marked.where(~F.col(maybe)).drop(maybe).unionByName(rest.join(side, rest["doc_id"] == side[key], "left_anti"))


def pieces(batch: pa.RecordBatch, column: str, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about so many bytes of text each."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # else a worker holds the batches it is done with


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """fn over runs of rows of bounded text; Arrow in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, chars):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from offsets (one more than rows) and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def text_key(text: Column) -> Column:
    """A 64-bit key of a text for telling rows of one doc_id apart."""
    return F.xxhash64(text)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
