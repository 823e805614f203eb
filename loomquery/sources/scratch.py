"""A folder for written intermediate tables: the shared one that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_written: list[str] = []


def _local(path: str) -> str | None:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return path if path.startswith("/") else None


@atexit.register
def _clean() -> None:
    """What this process wrote on local or mounted paths goes with it."""
    for path in map(_local, _written):
        if path:
            shutil.rmtree(path, ignore_errors=True)


def release(spark: SparkSession) -> None:
    """Delete what this process wrote, on any file system; results that are still read from it must be kept before."""
    while _written:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a session within this process (master local) gets one in the
    temporary folder; executors of a cluster would each write to their own disks there, so that is a ValueError."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loomquery-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A path below it that isn't in use."""
    _written.append(f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]
