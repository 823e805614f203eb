"""Writers that run beside a session: batches of changes for the log, and compaction at intervals."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql.types import StringType, StructField, StructType

from loomquery.schema import DOCUMENT, duration
from loomquery.sources.store import Namespace

_ROW = StructType([StructField("op", StringType()), *[StructField(f.name, f.dataType) for f in DOCUMENT]])


class BatchedWriter:
    """Single changes gathered into one log folder: ``most`` of them, or what has come when ``interval`` (seconds or a
    duration such as 5s) is over. A change's future is done once the folder is durable, or holds what went wrong; a change
    that can't be stored fails by itself."""

    def __init__(self, namespace: Namespace, most: int = 1, interval: float | str = 0):
        self.namespace, self.most = namespace, max(1, most)
        self.interval = (duration(interval) if isinstance(interval, str) else float(interval)) or 3600.0
        self._waiting: list[tuple[tuple, Future]] = []
        self._lock, self._flushing = threading.Lock(), threading.Lock()
        self._timer: threading.Timer | None = None

    def upsert(self, id: str, vector: list[float], text: str | None = None, attributes: str | None = None) -> Future:
        dims = self.namespace.manifest().dimensions
        if id is None or not vector or not all(abs(x) < float("inf") for x in vector) or (dims and len(vector) != dims):
            return self._failed(ValueError("an id and a finite vector of the namespace's length are needed"))
        return self._add(("upsert", id, [float(x) for x in vector], text, attributes))

    def delete(self, id: str) -> Future:
        return self._failed(ValueError("an id is needed")) if id is None else self._add(("delete", id, None, None, None))

    @staticmethod
    def _failed(error: Exception) -> Future:
        out: Future = Future()
        out.set_exception(error)
        return out

    def _add(self, change: tuple) -> Future:
        done: Future = Future()
        with self._lock:
            self._waiting.append((change, done))
            full = len(self._waiting) >= self.most
            if not full and self._timer is None:
                self._timer = threading.Timer(self.interval, self.flush)
                self._timer.daemon = True
                self._timer.start()
        if full:
            self.flush()
        return done

    def flush(self) -> int:
        """Write what waits, in order; how many changes."""
        with self._flushing:  # batches reach the log one after the other
            with self._lock:
                batch, self._waiting = self._waiting, []
                if self._timer is not None:
                    self._timer.cancel()
                    self._timer = None
            if not batch:
                return 0
            try:
                # one partition: the order of its rows is that of the changes
                self.namespace.append(self.namespace.spark.createDataFrame([c for c, _ in batch], _ROW).coalesce(1))
            except Exception as e:
                for _, done in batch:
                    done.set_exception(e)
                return 0
            for _, done in batch:
                done.set_result(None)
            return len(batch)

    def close(self) -> None:
        self.flush()


class Compactor:
    """Compacts a namespace at once and then at intervals (seconds or a duration such as 5m), until it is stopped. A round
    that another writer wins, or that fails, is noted in ``errors`` and tried again at the next."""

    def __init__(self, namespace: Namespace, interval: float | str = 300.0, after: Callable[[], None] | None = None):
        self.namespace, self.after = namespace, after
        self.interval = duration(interval) if isinstance(interval, str) else float(interval)
        self.rounds, self.last_run, self.errors = 0, None, []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def run_once(self) -> bool:
        """Whether a generation was committed."""
        before = self.namespace.manifest().generation
        try:
            done = self.namespace.compact().generation > before
        except Exception as e:
            self.errors.append(e)
            return False
        finally:
            self.rounds, self.last_run = self.rounds + 1, time.time()
        if done and self.after is not None:
            self.after()
        return done

    def start(self) -> Compactor:
        def loop() -> None:
            while not self._stop.is_set():
                self.run_once()
                self._stop.wait(self.interval)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
