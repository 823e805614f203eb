"""Namespaces on a file system that Hadoop reads: change log, segments with their indexes, manifests, tombstones.

    {root}/{namespace}/wal/<time>-<uuid>/      changes, appended; read once they are whole
    {root}/{namespace}/data/<kind>-<uuid>/     what a commit writes: segments (rows by id, with a Bloom filter on it), their
                                               text and vector indexes, tombstones, rows that newer ones replace
    {root}/{namespace}/manifests/<generation>  JSON: what a generation is made of
    {root}/{namespace}/claims/<generation>     the writer that is at work on a generation

A writer claims the next generation, writes folders of its own, and publishes the manifest that names them: a reader takes
the highest generation, so it sees all of a commit or nothing, writers never touch what another wrote, and of two that
publish one generation the second fails and removes its folders. Older generations can be read as they were until
``vacuum``. Log folders taken in are named in the manifest and deleted by the commit after, so readers keep their files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomquery.functions.text import Tokenizer
from loomquery.functions.vectors import norm
from loomquery.operators import bm25, ivf, quantize, versions
from loomquery.schema import CHANGE, DOCUMENT, TOMBSTONES, Metric
from loomquery.sources.files import Files

#: How long a writer may take from claiming a generation to committing it, before another may try.
CLAIM_SECONDS = 300
#: Ids from Parquet files of at most so many bytes are broadcast.
BROADCAST_BYTES = 8 << 20
ORDER = ("ts", "file", "seq")
DEAD = "segment int, id string, dl long"


@dataclass(frozen=True)
class Segment:
    """A segment of a manifest: its folders, rows, and the tokens of its texts. index: the folder of its inverted file."""

    id: int
    path: str
    doc_count: int
    size_bytes: int
    dimensions: int | None
    text: str | None = None
    total_len: int = 0
    index: str | None = None


@dataclass(frozen=True)
class Manifest:
    """taken: log folders that the segments hold already. dead: rows of segments that newer segments replace or delete, which
    dead_in names."""

    generation: int = 0
    created_at: int = 0
    dimensions: int | None = None
    segments: list[Segment] = field(default_factory=list)
    watermark: int = -1
    tombstones: str | None = None
    taken: list[str] = field(default_factory=list)
    dead: str | None = None
    dead_docs: int = 0
    dead_len: int = 0
    dead_in: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(**d | {"segments": [Segment(**s) for s in d["segments"]]})

    def folders(self) -> set[str]:
        return {p for s in self.segments for p in (s.path, s.text, s.index) if p} | {p for p in (self.tombstones, self.dead) if p}


@dataclass(frozen=True)
class Indexing:
    """What a commit writes beside the rows of a segment: postings of its texts, and from least_rows rows on an inverted
    file of its vectors with codes (quantization: sq8, f16 or none)."""

    metric: Metric = Metric.COSINE
    quantization: str = "sq8"
    least_rows: int = ivf.LEAST_ROWS
    clusters: int | None = None
    text: bool = True
    tokenizer: Tokenizer = Tokenizer()


@dataclass(frozen=True)
class IndexPart:
    """An inverted file: its centroids, its rows, and how their codes are read."""

    segment: int
    ivf: ivf.Ivf
    rows: DataFrame
    quantization: str
    calibration: tuple[list, list] | None


class Snapshot:
    """A namespace at one moment: a manifest, the log folders after it, and the changes of a live table, if there is one.
    All parts of a search read the same."""

    def __init__(self, ns: Namespace, manifest: Manifest, files: list[str], table=None):
        self.ns, self.spark, self.manifest, self.files, self.table = ns, ns.spark, manifest, files, table

    @property
    def state(self) -> tuple:
        return self.manifest.generation, tuple(self.files), self.table.version() if self.table is not None else None

    @cached_property
    def log(self) -> DataFrame | None:
        """All changes that aren't in segments, with the folder's name for ties in time; None if there are none."""
        parts = []
        if self.files:
            changes = self.spark.read.schema(CHANGE).parquet(*self.files)
            parts.append(changes.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"/wal/([^/]+)/", 1)))
        if self.table is not None:
            parts.append(self.table.changes().where(F.col("ts") > self.manifest.watermark).select(*CHANGE.fieldNames()).withColumn("file", F.lit("")))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @cached_property
    def last(self) -> DataFrame | None:
        """The last change of each id."""
        return None if self.log is None else versions.latest_change(self.log, ORDER)

    @cached_property
    def changed(self) -> DataFrame | None:
        """(id) of all that the log changes, without the rows themselves."""
        return None if self.log is None else self.log.select("id").distinct()

    def _segments(self, some: list[Segment], read: Callable[[Segment], DataFrame]) -> DataFrame | None:
        out = None
        for s in some:
            part = read(s).withColumn("segment", F.lit(s.id))
            out = part if out is None else out.unionByName(part)
        return out

    @property
    def dead(self) -> DataFrame | None:
        return self.spark.read.schema(DEAD).parquet(self.manifest.dead) if self.manifest.dead else None

    @cached_property
    def hidden(self) -> DataFrame | None:
        """(id) of all that the log changes; to be broadcast where the files it comes from are small."""
        if self.last is None:
            return None
        size = sum(map(self.ns.files.size, self.files)) + (self.ns.files.size(self.table.path) if self.table is not None else 0)
        return F.broadcast(self.changed) if size <= BROADCAST_BYTES else self.changed

    def visible(self, rows: DataFrame) -> DataFrame:
        """rows (segment, id, ...) without those that newer segments replace and those that the log changes. Segments without
        replaced rows aren't joined: their number is a constant, so the plan has no branch for them there."""
        if self.manifest.dead:
            some = F.col("segment").isin(self.manifest.dead_in)
            dead = self.dead.select("segment", "id")
            dead = F.broadcast(dead) if self.ns.files.size(self.manifest.dead) <= BROADCAST_BYTES else dead
            rows = rows.where(~some).unionByName(rows.where(some).join(dead, ["segment", "id"], "left_anti").select(rows.columns))
        return rows if self.last is None else rows.join(self.hidden, "id", "left_anti").select(rows.columns)

    def segment_rows(self, some: list[Segment] | None = None) -> DataFrame:
        """Rows of segments (all of them), with the segment's number."""
        some = self.manifest.segments if some is None else some
        out = self._segments(some, lambda s: self.spark.read.parquet(s.path))
        if out is None:
            out = self.spark.createDataFrame([], DOCUMENT).withColumn("norm", F.lit(0.0)).withColumn("segment", F.lit(0))
        return out.select(*DOCUMENT.fieldNames(), "norm", "segment")

    def stored(self, some: list[Segment] | None = None) -> DataFrame:
        """The visible rows of segments."""
        return self.visible(self.segment_rows(some)).select(*DOCUMENT.fieldNames())

    def fresh(self) -> DataFrame | None:
        """The rows that the log gives."""
        return None if self.last is None else self.last.where("op = 'upsert'").select(*DOCUMENT.fieldNames())

    def rows(self) -> DataFrame:
        """The rows that a search sees."""
        fresh = self.fresh()
        return self.stored() if fresh is None else self.stored().unionByName(fresh)

    def with_segments(self) -> DataFrame:
        """The same with the number of the segment, for statistics of each by itself; the log is one, too."""
        stored = self.visible(self.segment_rows()).select(*DOCUMENT.fieldNames(), "segment")
        fresh = self.fresh()
        return stored if fresh is None else stored.unionByName(fresh.withColumn("segment", F.lit(-1)))

    # text
    @property
    def has_text_index(self) -> bool:
        return all(s.text for s in self.manifest.segments)

    def postings(self, terms: list[str], tokenizer: Tokenizer) -> DataFrame:
        """(id, dl, term, tf) of the terms in visible rows; the terms are pushed to the scan of the segments' postings."""
        terms = list(dict.fromkeys(terms))
        stored = self._segments(self.manifest.segments, lambda s: self.spark.read.parquet(f"{s.text}/postings").where(F.col("term").isin(terms)))
        out = None if stored is None else self.visible(stored).select("id", "dl", "term", "tf")
        if self.last is not None:
            new = bm25.postings(self.fresh().select("id", "text"), tokenizer).where(F.col("term").isin(terms))
            out = new if out is None else out.unionByName(new)
        return self.spark.createDataFrame([], "id string, dl long, term string, tf long") if out is None else out

    def text_stats(self, tokenizer: Tokenizer) -> DataFrame:
        """(n_docs, total_len, avgdl) of the visible rows: those of the manifest, less what the log hides, and the log's."""
        m = self.manifest
        parts = self.spark.createDataFrame([(sum(s.doc_count for s in m.segments) - m.dead_docs, sum(s.total_len for s in m.segments) - m.dead_len)], "n long, len long")
        if self.last is not None:
            parts = parts.unionByName(bm25.doc_lengths(self.fresh().select("id", "text"), tokenizer).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len")))
            lengths = self._segments(m.segments, lambda s: self.spark.read.parquet(f"{s.text}/lengths"))
            if lengths is not None:
                if m.dead:
                    lengths = lengths.join(self.dead.select("segment", "id"), ["segment", "id"], "left_anti")
                hidden = lengths.join(self.changed, "id", "left_semi")
                parts = parts.unionByName(hidden.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("len")))
        out = parts.agg(F.sum("n").alias("n_docs"), F.sum("len").alias("total_len"))
        return out.withColumn("avgdl", bm25.average_length(F.col("total_len"), F.col("n_docs")))

    # vectors
    def index_parts(self, metric: Metric) -> tuple[list[IndexPart], list[Segment]]:
        """The inverted files of the metric, and the segments that have none."""
        parts, rest = [], []
        for s in self.manifest.segments:
            part = self.ns.index_part(s) if s.index else None
            if part is not None and part.ivf.metric is metric:
                parts.append(part)
            else:
                rest.append(s)
        return parts, rest


class Namespace:
    """One isolated set of documents."""

    def __init__(self, spark: SparkSession, root: str, name: str, indexing: Indexing = Indexing(), table=None):
        self.spark, self.name, self.path, self.files, self.indexing, self.table = spark, name, f"{root}/{name}", Files(spark), indexing, table
        self._parts: dict[str, IndexPart] = {}

    # change log
    def upsert(self, docs: DataFrame, ts: int | None = None) -> None:
        """Append upserts of whole documents (id, vector[, text, attributes]); no rows, missing ids, empty or non-finite
        vectors and vectors of another length than the namespace's are a ValueError before anything is written."""
        have = docs.columns
        rows = docs.select("id", F.col("vector").cast("array<float>").alias("vector"), *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("text", "attributes")])
        bad_number = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull() | F.col("vector").isNull() | (F.size("vector") == 0) | bad_number).alias("bad"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
        if not seen.n:
            raise ValueError("no documents")
        if seen.bad:
            raise ValueError(f"{seen.bad} documents lack an id or a finite vector")
        dims = self.manifest().dimensions
        if seen.lo != seen.hi or (dims and dims != seen.lo):
            raise ValueError(f"dimension mismatch: {seen.lo} to {seen.hi}, namespace {dims}")
        self._append(rows.withColumn("op", F.lit("upsert")), ts)

    def delete(self, ids: DataFrame, ts: int | None = None) -> None:
        """Append deletes of (id); ids that don't exist are no error, no ids are."""
        if ids.isEmpty():
            raise ValueError("no ids")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT if f.name != "id"]
        self._append(ids.select("id", *empty, F.lit("delete").alias("op")), ts)

    def append(self, changes: DataFrame, ts: int | None = None) -> None:
        """Append changes (op, id[, vector, text, attributes]) of both kinds, which were validated, in one folder."""
        self._append(changes, ts)

    def _append(self, rows: DataFrame, ts: int | None) -> None:
        now = time.time_ns() if ts is None else ts
        changes = rows.select(F.lit(now).cast("long").alias("ts"), F.monotonically_increasing_id().alias("seq"), "op", *DOCUMENT.fieldNames())
        changes.write.parquet(f"{self.path}/wal/{now:020d}-{uuid.uuid4().hex}")

    def log_files(self, manifest: Manifest | None = None) -> list[str]:
        """The whole log folders that aren't in segments yet; one that is still being written is left for later."""
        taken = set((manifest or self.manifest()).taken)
        return [f"{self.path}/wal/{f}" for f in self.files.whole(f"{self.path}/wal") if f not in taken]

    # snapshots
    def generations(self) -> list[int]:
        return sorted(int(g) for g in self.files.list(f"{self.path}/manifests") if g.isdigit())

    def manifest(self, generation: int | None = None) -> Manifest:
        """The newest manifest, or that of an older generation."""
        known = self.generations()
        if not known:
            return Manifest()
        return Manifest.parse(self.files.read(f"{self.path}/manifests/{known[-1] if generation is None else generation}"))

    def snapshot(self, generation: int | None = None, with_log: bool = True) -> Snapshot:
        """What a search sees now, or an older generation without its log."""
        m = self.manifest(generation)
        now = generation is None and with_log
        return Snapshot(self, m, self.log_files(m) if now else [], self.table if now else None)

    def segments(self, manifest: Manifest | None = None) -> DataFrame:
        """Rows of all segments of a snapshot with their segment's number, replaced ones too."""
        return Snapshot(self, manifest or self.manifest(), []).segment_rows()

    def tombstones(self, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self.spark.read.schema(TOMBSTONES).parquet(manifest.tombstones) if manifest.tombstones else self.spark.createDataFrame([], TOMBSTONES)

    def live(self, generation: int | None = None, with_log: bool = True) -> DataFrame:
        """The rows that a search sees: those of segments that nothing newer replaces, and those of the changes not yet
        compacted."""
        return self.snapshot(generation, with_log).rows()

    # commits
    @contextmanager
    def _writing(self, old: Manifest) -> Iterator[Callable[[str], str]]:
        """Claim the generation after old; gives names for folders, which go if the commit fails. The claim ends with it."""
        at = f"{self.path}/claims/{old.generation + 1}"
        token = self.files.claim(at, CLAIM_SECONDS)
        if token is None:
            raise RuntimeError(f"generation {old.generation + 1} belongs to another writer")
        made: list[str] = []

        def folder(kind: str) -> str:
            made.append(f"{self.path}/data/{kind}-{uuid.uuid4().hex}")
            return made[-1]

        try:
            yield folder
        except BaseException:
            for path in made:
                self.files.delete(path)
            raise
        finally:
            if self.files.exists(at) and self.files.read(at) == token:
                self.files.delete(at)

    def _commit(self, manifest: Manifest) -> None:
        """Publish a manifest; a generation is published once."""
        if not self.files.publish(f"{self.path}/manifests/{manifest.generation}", json.dumps(asdict(manifest))):
            raise RuntimeError(f"generation {manifest.generation} was committed by another writer")

    @staticmethod
    def _by_id(rows: DataFrame, changes: bool) -> DataFrame:
        """The rows of a segment in its order. Of changes the last of each id counts, which is found where they are sorted
        anyway: texts and vectors move once."""
        rows = rows.repartitionByRange("id")
        if changes:
            w = W.partitionBy("id").orderBy(*[F.col(c).desc() for c in ORDER])
            rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op = 'upsert' and size(vector) > 0")
        return rows.select(*DOCUMENT.fieldNames(), norm(F.col("vector")).alias("norm")).sortWithinPartitions("id")

    def _segment(self, rows: DataFrame, number: int, folder: Callable[[str], str], changes: bool = False) -> Segment | None:
        """Write rows, or what changes make, as a segment with its indexes; None if there are no rows."""
        path = folder("segment")
        self._by_id(rows, changes).write.option("parquet.bloom.filter.enabled#id", "true").parquet(path)
        written = self.spark.read.parquet(path)
        seen = written.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        if not seen.n:
            return None
        out = Segment(number, path, seen.n, self.files.size(path), seen.d)
        if self.indexing.text:
            text = folder("text")
            out = replace(out, text=text, total_len=bm25.build_index(written.select("id", "text"), text, self.indexing.tokenizer))
        return self._indexed(out, folder, self.indexing)

    def _indexed(self, segment: Segment, folder: Callable[[str], str], how: Indexing) -> Segment:
        """The segment with an inverted file, where it has rows enough."""
        if how.quantization not in ("sq8", "f16", "none", ""):
            raise ValueError(f"unknown quantization: {how.quantization}")
        if not ivf.use_index(segment.doc_count, least_rows=how.least_rows):
            return segment
        rows = self.spark.read.parquet(segment.path)
        found, placed = ivf.fit(rows.select("id", "vector", "attributes", "norm"), how.clusters, how.metric)
        lo, scale = quantize.collected(quantize.calibrate(rows)) if how.quantization == "sq8" else ([], [])
        if lo:
            placed = placed.withColumn("code", F.transform(quantize.encode(F.col("vector"), lo, scale), lambda c: c.cast("short")))
        elif how.quantization == "f16":
            placed = quantize.with_half(placed)
        path = folder("index")
        ivf.write(placed, f"{path}/rows")
        meta = {"metric": how.metric.value, "centroids": found.centroids.tolist(), "radii": found.radii.tolist(), "lo": lo, "scale": scale, "quantization": how.quantization, "probes": found.probes}
        self.files.write(f"{path}/meta", json.dumps(meta))
        return replace(segment, index=path)

    def index_part(self, segment: Segment) -> IndexPart:
        if segment.index not in self._parts:
            meta = json.loads(self.files.read(f"{segment.index}/meta"))
            found = ivf.Ivf(np.array(meta["centroids"]), np.array(meta["radii"]), Metric(meta["metric"]), meta["probes"])
            self._parts[segment.index] = IndexPart(segment.id, found, self.spark.read.parquet(f"{segment.index}/rows"), meta["quantization"], (meta["lo"], meta["scale"]) if meta["lo"] else None)
        return self._parts[segment.index]

    def compact(self) -> Manifest:
        """Take the change log into a new segment with its indexes. A second writer at the same time is a RuntimeError, and
        leaves all as it is."""
        old = self.manifest()
        if not self.log_files(old):
            return old
        with self._writing(old) as folder:
            taken = self.log_files(old)  # listed once: what is read is what is taken
            view = Snapshot(self, old, taken)
            new = self._segment(view.log, 1 + max((s.id for s in old.segments), default=-1), folder, changes=True)
            tombstones = folder("tombstones")
            versions.merge_tombstones(self.tombstones(old), view.log, ORDER).write.parquet(tombstones)
            dead = self._dead(view, folder) if old.segments else (None, 0, 0, [])
            names = [f.rsplit("/", 1)[1] for f in taken]
            segments = [*old.segments, new] if new else old.segments
            made = Manifest(old.generation + 1, time.time_ns(), old.dimensions or (new.dimensions if new else None), segments, max(old.watermark, *(int(n.split("-")[0]) for n in names)), tombstones, names, *dead)
            self._commit(made)
        for name in old.taken:  # readers of the generation before may still be at those of this one
            self.files.delete(f"{self.path}/wal/{name}")
        return made

    def _dead(self, view: Snapshot, folder: Callable[[str], str]) -> tuple[str, int, int, list[int]]:
        """Write the rows of segments that are replaced or deleted, those of this log too: the folder, rows, tokens, segments."""
        read = lambda s: self.spark.read.parquet(f"{s.text}/lengths") if s.text else self.spark.read.parquet(s.path).select("id", F.lit(0).cast("long").alias("dl"))
        hit = view._segments(view.manifest.segments, read).join(view.changed, "id", "left_semi").select("segment", "id", "dl")
        if view.manifest.dead:
            hit = hit.join(view.dead.select("segment", "id"), ["segment", "id"], "left_anti").unionByName(view.dead)
        path = folder("dead")
        hit.write.parquet(path)
        seen = self.spark.read.schema(DEAD).parquet(path).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len"), F.collect_set("segment").alias("of")).first()
        return path, seen.n, seen.len, sorted(seen.of)

    def fold(self) -> Manifest:
        """Rewrite all live compacted rows as one segment, without replaced and deleted ones; older generations stay
        readable."""
        old = self.manifest()
        if not old.segments:
            return old
        with self._writing(old) as folder:
            one = self._segment(Snapshot(self, old, []).rows(), 1 + max(s.id for s in old.segments), folder)
            made = replace(old, generation=old.generation + 1, created_at=time.time_ns(), segments=[one] if one else [], tombstones=None, dead=None, dead_docs=0, dead_len=0, dead_in=[])
            self._commit(made)
        return made

    def build_index(self, metric: Metric = Metric.COSINE, quantization: str = "sq8", least_rows: int = ivf.LEAST_ROWS, clusters: int | None = None) -> bool:
        """Give the segments inverted files anew, by these options; False if none has rows enough."""
        old = self.manifest()
        how = replace(self.indexing, metric=metric, quantization=quantization, least_rows=least_rows, clusters=clusters)
        if not any(ivf.use_index(s.doc_count, least_rows=least_rows) for s in old.segments):
            return False
        with self._writing(old) as folder:
            self._commit(replace(old, generation=old.generation + 1, created_at=time.time_ns(), segments=[self._indexed(s, folder, how) for s in old.segments]))
        return True

    def vacuum(self, keep: int = 1) -> list[int]:
        """Forget all but the newest generations and delete what only they hold; the generations forgotten."""
        known = self.generations()
        gone, kept = known[: len(known) - max(1, keep)], known[len(known) - max(1, keep) :]
        held = set().union(*(self.manifest(g).folders() for g in kept)) if kept else set()
        for g in gone:
            for path in self.manifest(g).folders() - held:
                self.files.delete(path)
            self.files.delete(f"{self.path}/manifests/{g}")
        return gone

    # status
    def info(self) -> dict:
        """approx_count counts overwritten and deleted rows too; exact counts are ``live().count()``."""
        m = self.manifest()
        return {"namespace": self.name, "approx_count": sum(s.doc_count for s in m.segments), "dimensions": m.dimensions, "pending_compaction": bool(self.log_files(m)) and m.generation == 0}

    def status(self) -> dict:
        m = self.manifest()
        view = Snapshot(self, m, self.log_files(m))
        return {"last_run": m.created_at or None, "wal_files": len(view.files), "wal_entries": view.log.count() if view.files else 0, "segments": len(m.segments), "total_vecs": sum(s.doc_count for s in m.segments), "dimensions": m.dimensions}
