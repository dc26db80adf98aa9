"""Tables that cut lineage: written to the folder that driver and executors share, and deleted when done."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which an execution deletes its shuffle files when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}  # folders of our own by application, in local mode
_lock = threading.Lock()
_writing: dict[str, tuple[int, str]] = {}  # by application: how many threads write now, and the setting before the first did
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees; one of our own only in local mode (tests), deleted at the end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        with _lock:
            app = spark.sparkContext.applicationId
            if app not in _own:
                _own[app] = tempfile.mkdtemp(prefix="crawlspark-")
                atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
            base = _own[app]
    return base.rstrip("/")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted at its end; the setting goes back when the last of several threads is done."""
    app = spark.sparkContext.applicationId
    with _lock:
        n, before = _writing.get(app, (0, spark.conf.get(CLEANUP)))
        _writing[app] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(app)
            if n > 1:
                _writing[app] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends in files that outlive any executor.

    The shuffle files of the writing are deleted as soon as it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlspark/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.stored_at = path
    if scopes := _open():
        scopes[-1].append(table_)
    return table_


def _open() -> list[list[DataFrame]]:
    """The scopes of this thread."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``durable`` whose every reader's result has been written by now."""
    for t in tables:
        keep(t)
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def keep(table: DataFrame) -> DataFrame:
    """``table`` of ``durable``, which outlives the ``scratch`` it was written in."""
    for scope in _open():
        scope[:] = [x for x in scope if x is not table]
    return table


def passed_on(table: DataFrame) -> DataFrame:
    """``table`` of ``durable``, which outlives the innermost ``scratch`` and belongs to the one around it, if there is one."""
    keep(table)
    if len(_open()) > 1:
        _open()[-2].append(table)
    return table


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end every table that ``durable`` wrote inside it, in this thread, and that is not ``keep``-t or deleted by then."""
    _open().append([])
    try:
        yield
    finally:
        discard(*_open().pop())
