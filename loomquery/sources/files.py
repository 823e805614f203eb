"""File operations on any Hadoop file system, through the session."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


class Files:
    """``publish`` and ``claim`` let one of several writers win. They are atomic on HDFS (a rename doesn't overwrite), on
    local and mounted file systems (a hard link doesn't either), and on object stores whose connector creates
    conditionally (S3A from Hadoop 3.4.2 on with ``fs.s3a.create.conditional.enabled``, GCS, ABFS); on others keep writers
    apart by other means."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def whole(self, path: str) -> list[str]:
        """Names of the folders in path that their writer has finished."""
        fs, p = self._at(f"{path}/*/_SUCCESS")
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(p) or [])

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new))

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Let a whole file appear under a name that isn't taken; False if it is."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        scheme = fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                self.write(path, text, overwrite=False)
                return True
            except Exception:
                if fs.exists(p):
                    return False
                raise
        folder, name = path.rsplit("/", 1)
        beside = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.write(beside, text)
        if scheme != "file":
            return fs.rename(self.jvm.org.apache.hadoop.fs.Path(beside), p) or self.delete(beside) and False
        at = lambda x: self.jvm.java.nio.file.Paths.get(self.jvm.org.apache.hadoop.fs.Path(x).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
        try:
            self.jvm.java.nio.file.Files.createLink(at(path), at(beside))
            return True
        except Exception:
            if fs.exists(p):
                return False
            raise
        finally:
            self.delete(beside)

    def claim(self, path: str, stale: float) -> str | None:
        """Own a name until it is deleted, or for stale seconds: the token that tells this owner from the next; None if
        another owns it."""
        token = uuid.uuid4().hex
        if self.publish(path, token):
            return token
        fs, p = self._at(path)
        try:
            if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < stale:
                return None
            fs.delete(p, False)
        except Exception:  # given up meanwhile
            if fs.exists(p):
                raise
        return token if self.publish(path, token) else None
