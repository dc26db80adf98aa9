"""Versions of a table under one folder: each is a small file that names what the version consists of.

A version is written to a file of another name first and then published without
overwriting, so a reader sees the version before or the new one whole, and of two writers of
one version exactly one wins. A writer that dies leaves at most a file that nobody reads. (Local file systems
publish by a hard link, others by a rename that refuses an existing name, as HDFS does;
object stores that rename by copying give no such guarantee.)
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The numbered versions in ``root``; each holds one line of text."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int):
        return self._path(f"{self.root}/{version:08d}")

    def newest(self) -> int:
        """The newest version; 0 before the first commit."""
        at = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def text(self, version: int) -> str:
        stream = self._fs.open(self._at(version))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, text: str, base: int) -> int:
        """Publishes ``text`` as the version after ``base``; RuntimeError where another writer was sooner."""
        at, temporary = self._at(base + 1), self._path(f"{self.root}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(temporary, False)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                with contextlib.suppress(FileExistsError):
                    os.link(temporary.toUri().getPath(), at.toUri().getPath())
                    return base + 1
            elif not self._fs.exists(at) and self._fs.rename(temporary, at):
                return base + 1
        finally:
            self._fs.delete(temporary, False)
        raise RuntimeError(f"version {base + 1} was committed by another writer; read the newest one and retry")
