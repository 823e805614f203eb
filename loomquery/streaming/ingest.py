"""Streaming ingest: a change stream merged into a table of live rows, and a buffer of recent rows.

The merged table is a base with deltas: a batch costs what it holds, and one that is run again after a failure does no
harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomquery.operators import versions
from loomquery.sources.files import Files


class LiveTable:
    """The last change of every id, deletes included, so that late changes still lose to newer ones.

    A micro-batch writes only its own changes, as a delta; every ``fold`` batches the deltas and the base become a new
    base. Reading replays the base and the deltas after it."""

    def __init__(self, spark: SparkSession, path: str, schema, fold: int = 16):
        self.spark, self.path, self.schema, self.fold, self.files = spark, path, schema, fold, Files(spark)

    def _done(self, kind: str) -> list[int]:
        return sorted(int(v.split("=")[1]) for v in self.files.list(self.path) if v.startswith(kind) and self.files.exists(f"{self.path}/{v}/_SUCCESS"))

    def version(self) -> int:
        """The last batch taken in."""
        return max([*self._done("base="), *self._done("delta=")], default=-1)

    def _parts(self) -> list[str]:
        base = max(self._done("base="), default=-1)
        return ([f"{self.path}/base={base}"] if base >= 0 else []) + [f"{self.path}/delta={d}" for d in self._done("delta=") if d > base]

    def changes(self) -> DataFrame:
        parts = self._parts()
        read = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return versions.latest_change(read) if len(parts) > 1 else read

    def rows(self) -> DataFrame:
        return self.changes().where(F.col("op") == "upsert").drop("op")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in; one that was taken in before is skipped, one that failed halfway is written over."""
        if self.version() >= batch_id:
            return
        versions.latest_change(batch.select(*self.schema.fieldNames())).write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
        if len(self._parts()) > self.fold:
            self.compact()

    def compact(self) -> None:
        """Fold all deltas into a new base; the base is whole before anything older goes. What the base replaces goes only
        with the next fold, so readers that planned with it can finish."""
        now, v = self._parts(), self.version()
        if len(now) > 1:
            self.changes().write.mode("overwrite").parquet(f"{self.path}/base={v}")
            for part in self._older(now):
                self.files.delete(part)

    def _older(self, used: list[str]) -> list[str]:
        """Folders that neither a reader of the parts used nor one of the new base needs."""
        held = {*used, *self._parts()}
        return [f"{self.path}/{n}" for n in self.files.list(self.path) if n.startswith(("base=", "delta=")) and f"{self.path}/{n}" not in held and int(n.split("=")[1]) < self.version()]

    def __len__(self) -> int:
        """Ids that the table holds a change of."""
        return self.changes().count()

    def trim(self, watermark: int) -> None:
        """Forget the changes up to a time, those that a compaction has taken: the rest becomes the new base."""
        now, v = self._parts(), self.version()
        if v >= 0:
            kept = self.changes().where(F.col("ts") > watermark)
            beside = f"{self.path}/_trim={v}"
            kept.write.mode("overwrite").parquet(beside)  # the base may be read while it is made
            self.files.delete(f"{self.path}/base={v}")
            self.files.rename(beside, f"{self.path}/base={v}")
            for part in self._older(now):
                self.files.delete(part)


def ingest(source: DataFrame, table: LiveTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start merging a stream of changes (ts, seq, op, id, ...) into a table; by default until the source is read up."""
    return source.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def expire(table: LiveTable, watermark: int) -> DataFrame:
    """The buffer after a compaction: changes newer than its watermark."""
    return table.changes().where(F.col("ts") > watermark)


def windowed_changes(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of changes by operation and event-time window, late data bounded by a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")
