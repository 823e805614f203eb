"""Sharding by sampled splitters.

Keys become bytes that sort as they do. They are sampled with a chance in proportion to the size of their rows (a row
larger than a sampling step always, with its own weight); quantiles of the sample's weights over the first key column
are the coarse splitters. Exact sizes of the ranges show which are overfull; those are subdivided, each by a task of its
own, at quantiles over the whole key (first key column, then the others), until none is overfull but those of one key.
Then the records are moved once, runs of neighbouring shards of about ``PARTITION_BYTES`` to a partition. The driver
holds a bounded sample, and of each shard its splitter and size; of shards there are at most ``MOST_SHARDS``, so beyond
that many targets of input the shards grow instead.

Defined cases: null keys (and NaN) sort first; a null text has no bytes, and every row counts one byte more than its
text, however long; a row is never cut, so one longer than the target is a shard with at most its neighbours; rows of
one key (repeated rows, ties) share a shard; an empty table gives no rows, without a shard; extra columns are kept, key
columns may have any name, and the shard's column gets leading underscores if its name is taken. Keys are of any type:
numbers, strings, binaries, dates and times in their own order (decimals of more than 18 digits as doubles), others by
their strings.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise, read

#: Bytes of text a shard; small, so that small tables are divided too. A partition writes many.
TARGET_BYTES, PARTITION_BYTES = 256 << 10, 32 << 20
#: Samples a part into which a range is divided.
SAMPLES = 64
#: A range is overfull beyond this multiple of the target.
OVERFULL = 1.25
#: Parts of the whole table in the first round, and of a range in each further round, at most; shards in all, at most.
COARSE, FANOUT, MOST_SHARDS = 1024, 256, 1 << 18


def _ordered(column: Column) -> Column:
    """Doubles as integers of the same order; NaN is null."""

    @F.arrow_udf("long")
    def bits(x: pa.Array) -> pa.Array:
        v = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        b = v.view(np.int64)
        return pa.array(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b), mask=np.isnan(v))

    return bits(column)


def encoded(df: DataFrame, name: str) -> Column:
    """A key column as bytes that sort as it does; no key is the beginning of another."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    number = None
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        number = c.cast("long")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(c).cast("long")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(c)
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        number = (c * F.lit(10**kind.scale)).cast("long")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        number = _ordered(c.cast("double"))
    if number is not None:
        value = F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    elif isinstance(kind, T.BinaryType):
        value = F.concat(F.encode(F.hex(c), "UTF-8"), F.lit(b"\0"))
    else:
        value = F.concat(F.encode(F.replace(c.cast("string"), F.lit("\0"), F.lit("\0ÿ")), "UTF-8"), F.lit(b"\0\0"))
    return F.coalesce(F.concat(F.lit(b"\1"), value), F.lit(b"\0"))


def assign(splitters: list[bytes], key: Column, spark: SparkSession) -> Column:
    """The range of each row: how many splitters are at most its key. Only the key goes to Python."""
    shared = spark.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def ranges(keys: pa.Array) -> pa.Array:
        known = shared.value
        return pa.array([bisect_right(known, k) for k in keys.to_pylist()], pa.int32())

    return ranges(key)


def _sample(rows: DataFrame, step: Column) -> DataFrame:
    """Rows drawn with chance size / step at most 1, with their weights."""
    u = F.shiftrightunsigned(F.xxhash64("key", "size", F.lit("sample")), 11).cast("double") / float(1 << 53)
    return rows.where(u * step < F.col("size")).withColumn("weight", F.greatest(F.col("size").cast("double"), step))


def _quantiles(keys: list[bytes], weights: list[float], parts: int) -> list[bytes]:
    """At most parts - 1 of the ascending keys, which cut the total weight evenly; of two keys or more at least one."""
    total, seen, cut, out = sum(weights), 0.0, 1, []
    for key, w in zip(keys, weights):
        if seen and seen >= cut * total / parts:
            out.append(key)
            while seen >= cut * total / parts and cut < parts:
                cut += 1
        seen += w
    if not out and len(keys) > 1:  # nearly all is one key's
        out.append(keys[max(1, weights.index(max(weights)))])
    return out


def _divide(key: tuple, group: pa.Table) -> pa.Table:
    group = group.sort_by("key")
    found = _quantiles(group.column("key").to_pylist(), group.column("weight").to_pylist(), group.column("parts")[0].as_py())
    return pa.table({"key": pa.array(found, pa.binary())})


def splitters(docs: DataFrame, keys: list[str], target: int = TARGET_BYTES, samples: int = SAMPLES) -> tuple[list[bytes], int]:
    """Ascending keys at which ranges begin, and the size of all rows."""
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    columns = [encoded(docs, k) for k in keys]
    rows = materialise(docs.select(F.concat(*columns).alias("key"), columns[0].alias("first"), size), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(target, -(-total // MOST_SHARDS))
    parts = min(COARSE, -(-total // target))
    if parts < 2:
        return [], total
    drawn = _sample(rows, F.lit(total / (samples * parts))).groupBy("first").agg(F.sum("weight").alias("weight")).orderBy("first").collect()
    found = [bytes(k) for k in _quantiles([bytes(r["first"]) for r in drawn], [r.weight for r in drawn], parts)]
    while True:
        placed = rows.withColumn("range", assign(found, F.col("key"), spark))
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        over = sizes.where((F.col("bytes") > OVERFULL * target) & (F.col("low") < F.col("high"))).collect()
        if not over:
            return found, total
        few = [(r["range"], min(FANOUT, -(-r.bytes // target)), float(r.bytes)) for r in over]
        steps = F.broadcast(spark.createDataFrame([(k, n, b / (samples * n)) for k, n, b in few], "range int, parts int, step double"))
        drawn = _sample(placed.join(steps, "range"), F.col("step")).groupBy("range", "key").agg(F.sum("weight").alias("weight"), F.first("parts").alias("parts"))
        more = {bytes(r.key) for r in drawn.groupBy("range").applyInArrow(_divide, "key binary").collect()} - set(found)
        if not more:  # an unlucky sample: the last key of each range begins one
            more = {bytes(r.high) for r in over}
        found = sorted({*found, *more})


def shard(docs: DataFrame, keys: list[str], target: int = TARGET_BYTES, samples: int = SAMPLES) -> DataFrame:
    """docs with the number of the range of each row; a range is in one partition."""
    found, total = splitters(docs, keys, target, samples)
    name, n = fresh(docs, "shard"), len(found) + 1
    partitions = max(1, min(n, -(-total // PARTITION_BYTES)))
    placed = docs.withColumn(name, assign(found, F.concat(*[encoded(docs, k) for k in keys]), docs.sparkSession))
    return placed.repartitionById(partitions, (F.col(name).cast("long") * partitions / n).cast("int"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), ["source", "doc_id"])
