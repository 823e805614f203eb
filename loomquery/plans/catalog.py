"""The catalog of namespaces under a root: listing, allow-list, cached searches, statistics."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from loomquery.functions.text import Tokenizer
from loomquery.plans.search import search_snapshot
from loomquery.schema import Mode, SearchRequest
from loomquery.sources.files import Files
from loomquery.sources.store import Indexing, Namespace, Snapshot


class Catalog:
    """Namespaces by name. Where a namespace has indexes, searches read those; the rows of at most ``most_cached`` others
    stay cached, the least recently used go first. A live table attached to a namespace is searched with it."""

    def __init__(self, spark: SparkSession, root: str, allowed: list[str] | None = None, most_cached: int = 8, tokenizer: Tokenizer = Tokenizer(), max_top_k: int = 1000, result_ttl: float = 60.0, idle: float | None = None, indexing: Indexing | None = None):
        self.spark, self.root, self.allowed = spark, root, set(allowed) if allowed else None
        self.most_cached, self.tokenizer, self.max_top_k, self.result_ttl, self.idle = most_cached, tokenizer, max_top_k, result_ttl, idle
        self.indexing = indexing or Indexing(tokenizer=tokenizer)
        self._rows: OrderedDict[str, tuple[tuple, DataFrame, float]] = OrderedDict()
        self._results: dict[str, tuple[float, list, object]] = {}
        self._tables: dict[str, object] = {}
        self._namespaces: dict[str, Namespace] = {}

    def namespace(self, name: str) -> Namespace:
        if self.allowed is not None and name not in self.allowed:
            raise KeyError(name)
        if name not in self._namespaces:
            self._namespaces[name] = Namespace(self.spark, self.root, name, self.indexing, self._tables.get(name))
        return self._namespaces[name]

    def attach(self, name: str, table) -> None:
        """Search a LiveTable of changes with the namespace: what it holds beyond the last compaction is fresher than the
        segments."""
        self._tables[name] = table
        self._namespaces.pop(name, None)

    def list(self) -> list[str]:
        return [n for n in Files(self.spark).list(self.root) if self.allowed is None or n in self.allowed]

    def infos(self) -> list[dict]:
        return [self.namespace(n).info() for n in self.list()]

    def active(self) -> list[str]:
        """Namespaces whose rows are cached, least recently used first."""
        return list(self._rows)

    def rows(self, name: str, view: Snapshot | None = None) -> DataFrame:
        """The live rows of a namespace, cached until its state changes."""
        view = view or self.namespace(name).snapshot()
        now = time.monotonic()
        if self.idle is not None:
            for other in [n for n, (_, _, used) in self._rows.items() if n != name and now - used > self.idle]:
                self._drop(other)
        held = self._rows.get(name)
        if held is None or held[0] != view.state:
            if held:
                self._drop(name)
            self._rows[name] = (view.state, view.rows().persist(), now)
        self._rows[name] = (*self._rows[name][:2], now)
        self._rows.move_to_end(name)
        while len(self._rows) > self.most_cached:
            self._drop(next(iter(self._rows)))
        return self._rows[name][1]

    def _drop(self, name: str) -> None:
        self._rows.pop(name)[1].unpersist()

    def search(self, name: str, request: SearchRequest) -> DataFrame:
        view = self.namespace(name).snapshot()
        # postings answer texts alone: rows are then read for the few found, not kept
        postings = request.resolved(view.manifest.dimensions, self.max_top_k).mode is Mode.TEXT and request.stats_scope != "segment" and view.manifest.segments and view.has_text_index and self.tokenizer == view.ns.indexing.tokenizer
        indexed = postings or any(s.index for s in view.manifest.segments)
        return search_snapshot(view, request, self.tokenizer, self.max_top_k, None if indexed else self.rows(name, view))

    def search_cached(self, name: str, request: SearchRequest) -> DataFrame:
        """The same from a cache of small results, keyed by request and state of the namespace; not with vectors."""
        if request.include_vectors:
            return self.search(name, request)
        key = json.dumps([name, self.namespace(name).snapshot().state, asdict(request)], sort_keys=True, default=str)
        now = time.monotonic()
        self._results = {k: v for k, v in self._results.items() if now - v[0] < self.result_ttl}
        if key not in self._results:
            found = self.search(name, request)
            self._results[key] = (now, found.collect(), found.schema)  # at most top_k rows
        _, rows, schema = self._results[key]
        return self.spark.createDataFrame(rows, schema)

    def stats(self, name: str) -> dict:
        """warming is whether a search may miss rows that aren't loaded yet: never, as all reads go to the files."""
        ns = self.namespace(name)
        m = ns.manifest()
        ids = ns.segments(m).select("id").distinct().count()
        return {"namespace": name, "distinct_ids": ids, "tombstones": ns.tombstones(m).count(), "live": ns.live().count(), "segments": len(m.segments), "generation": m.generation, "warming": False}
