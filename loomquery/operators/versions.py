"""Versions of rows: replay of change logs, tombstones, latest segments, the buffer of recent rows.

Last write wins by (ts, seq). Every operator is one aggregation or anti join by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_change(log: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The last change of each id. Partial aggregation keeps one change an id and task before the shuffle."""
    rest = [c for c in log.columns if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy("id").agg(last.alias("last")).select("id", *[F.col(f"last.{c}").alias(c) for c in rest])


def replay(log: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The live rows after all changes: the last upsert of each id that wasn't deleted later."""
    return upserts(latest_change(log, order))


def upserts(last: DataFrame) -> DataFrame:
    """The rows of last changes that aren't deletes."""
    return last.where(F.col("op") == "upsert").drop("op")


def deleted(log: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(id) whose last change is a delete."""
    return latest_change(log.select(*dict.fromkeys(["id", "op", *order])), order).where(F.col("op") == "delete").select("id")


def merge_tombstones(tombstones: DataFrame, log: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(tombstones and deleted ids) without those upserted last."""
    last = latest_change(log.select(*dict.fromkeys(["id", "op", *order])), order)  # aggregates take all columns along
    gone = tombstones.select("id").unionByName(last.where(F.col("op") == "delete").select("id")).distinct()
    return gone.join(last.where(F.col("op") == "upsert").select("id"), "id", "left_anti")


def without_tombstones(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("id"), "id", "left_anti")


def latest_segment(rows: DataFrame, segment: str = "segment") -> DataFrame:
    """Of each id the row of the highest segment; ids are unique within a segment. Only ids and segment numbers are
    aggregated; the rows themselves meet just the ids that stand in several segments."""
    many = rows.groupBy(F.col("id").alias("_id")).agg(F.max(segment).alias("_newest"), F.min(segment).alias("_oldest")).where("_newest <> _oldest").drop("_oldest")
    return rows.join(many, rows["id"] == many["_id"], "left").where(F.col("_newest").isNull() | (F.col(segment) == F.col("_newest"))).drop("_id", "_newest")


def overlay(segments: DataFrame, buffer: DataFrame, buffer_tombstones: DataFrame | None = None) -> DataFrame:
    """Segment rows, of which all ids of the buffer (and its tombstones) are hidden, and the buffer's rows."""
    hidden = buffer.select("id") if buffer_tombstones is None else buffer.select("id").unionByName(buffer_tombstones.select("id"))
    return segments.join(hidden, "id", "left_anti").unionByName(buffer)


def fifo(log: DataFrame, size: int) -> DataFrame:
    """The size live rows inserted last, by seq; an update keeps its place, an insert after a delete is new."""
    w = W.partitionBy("id").orderBy("seq")
    deletes = F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    lives = log.withColumn("life", deletes).where(F.col("op") == "upsert")
    born = lives.groupBy("id", "life").agg(F.min("seq").alias("born"), F.max("seq").alias("seq"))
    last = latest_change(log, ["seq"]).where(F.col("op") == "upsert").select("id", "seq")
    return born.join(last, ["id", "seq"]).select("id", "born", "seq").orderBy(F.col("born").desc()).limit(size)


def sync_diff(remote: DataFrame, local: DataFrame, keys: Sequence[str] = ("id", "content_hash")) -> DataFrame:
    """The rows of remote that local lacks or holds with another hash: what an incremental sync has to fetch."""
    return remote.join(local.select(*keys), list(keys), "left_anti")
