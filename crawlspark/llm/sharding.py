"""Sharding by size-tiered compaction.

Method: arrivals are appended as small immutable shards; compaction groups shards of
similar size (tiers of a factor ``fanout``) in order into runs of about ``target`` bytes
and rewrites each run as one shard; every change is one new version of the manifest. A
version is one small file that names its manifest table and appears whole under its name, so a reader
sees the old version or the new one, and of two writers of one version exactly one
wins; the other gets ``RuntimeError`` and has to retry (see ``sources.versions``). A writer
announces its run in a file before it writes and takes that back after its commit;
``vacuum`` spares announced runs for ``ABANDONED`` seconds, after which their writer counts as dead.

A shard is one file. An arrival is written as it lies, one shard for each of its
partitions and batches, in one scan without a shuffle. A compaction sends the rows of one
run to one task of its own; a shard of over ``SPLIT * target`` bytes is split by row
number, so a task holds less than ``SPLIT * target`` bytes, or one row. No source or key
decides where a row goes. The manifest is a table (one row per shard) and is planned as one;
only numbers and the names of runs (one per append or compaction in use) come to the driver.

Layout under ``root``: ``data/run=<run>/.../part-*.parquet``, ``manifest/<name>``, ``writing/<run>`` and ``versions/<version>``.

Defined cases: any columns, nulls and repeated rows are carried through unchanged (the
row is stored as a struct, so no name can clash); null text weighs 0 bytes; an empty
arrival adds no shard; a compaction with nothing to merge commits nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Versions
from .common import broadcast_if_small, durable, shared_dir

TARGET, ARRIVAL, FANOUT = 64 << 20, 8 << 20, 4
FULL = 0.75  # a shard of this share of the target is left as it is
SPLIT = 2  # a shard of so many targets is split (a run of shards under FULL never gets there)
STEPS, RUNS = 4, 10_000  # a compaction rewrites about 1 / STEPS of the store and RUNS shards at most; the next one goes on
ABANDONED = 7 * 86400  # seconds after which an announced run that was never committed is nobody's
MANIFEST = "shard string, run string, tier int, rows bigint, bytes bigint"


class ShardStore:
    """Immutable shards of rows of one schema under ``root``, and the versions of their manifest."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target: int = TARGET, arrival: int = ARRIVAL, fanout: int = FANOUT):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.arrival, self.fanout = target, arrival, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._versions = Versions(spark, f"{self.root}/versions")

    # --- manifest

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return self._versions.newest()

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._versions.text(v)}")

    def _commit(self, manifest: DataFrame, base: int) -> int:
        name = uuid.uuid4().hex
        manifest.select("shard", "run", "tier", "rows", "bytes").write.parquet(f"{self.root}/manifest/{name}")
        return self._versions.commit(name, base)

    @contextmanager
    def _announced(self) -> Iterator[str]:
        """A new run, announced before its first file is written and until it is committed (or failed: then its files are nobody's)."""
        run = uuid.uuid4().hex
        at = self._path(f"{self.root}/writing/{run}")
        self._fs.create(at, False).close()
        try:
            yield run
        finally:
            self._fs.delete(at, False)

    def _tier(self, size: Column) -> Column:
        return F.when(size <= self.arrival, 0).otherwise(F.floor(F.log(float(self.fanout), size / self.arrival))).cast("int")

    # --- data

    def _data(self, runs: list[str]) -> DataFrame:
        """row, _bytes, shard (its file under ``data``) and i (its place there) of every row that some runs hold."""
        schema = T.StructType([T.StructField("row", self.schema), T.StructField("_bytes", T.LongType())])
        if not runs:
            return self.spark.createDataFrame([], T.StructType([*schema, T.StructField("shard", T.StringType()), T.StructField("i", T.LongType())]))
        read = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{self.root}/data/run={r}" for r in runs])
        return read.select("row", "_bytes", F.regexp_extract("_metadata.file_path", r"/(run=[0-9a-f]{32}/.*)$", 1).alias("shard"), F.col("_metadata.row_index").alias("i"))

    def _stats(self, run: str) -> DataFrame:
        stats = self._data([run]).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").cast("bigint").alias("bytes"))
        return stats.select("shard", F.lit(run).alias("run"), self._tier(F.col("bytes")).alias("tier"), "rows", "bytes")

    def append(self, df: DataFrame, batch: Column | None = None, batches: int = 1) -> int:
        """Adds ``df``, each of its partitions as one shard, so without a shuffle; returns the new version.

        With ``batch`` (a number under ``batches``) the batches of one scan are committed one after the other.
        """
        base = self.version()
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in self.schema.names]).alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("_bytes"), (F.lit(0) if batch is None else batch).alias("batch"))
        with self._announced() as run:
            rows.write.option("compression", "zstd").partitionBy("batch").parquet(f"{self.root}/data/run={run}")
            added = durable(self._stats(run).withColumn("batch", F.regexp_extract("shard", r"/batch=(\d+)/", 1).cast("int")))
            before = self.manifest(base)
            for b in range(batches):
                self._commit(before.unionByName(added.where(F.col("batch") <= b).drop("batch")), base + b)
        return base + batches

    def plan(self, version: int) -> DataFrame:
        """shard, run, first, pieces: the shards that one compaction rewrites and the new shards (numbers from 0) they go to.

        Runs are taken in order until they hold ``1 / STEPS`` of the store, so that old and new shards together need little more room than the store.
        """
        shards = self.manifest(version)
        large = (F.col("bytes") >= SPLIT * self.target) & (F.col("rows") > 1)
        in_tier = Window.partitionBy("tier").orderBy("shard")
        merged = shards.where(F.col("bytes") < FULL * self.target).withColumn("before", F.sum("bytes").over(in_tier) - F.col("bytes"))
        merged = merged.select("shard", "run", "bytes", F.concat_ws("/", "tier", F.floor(F.col("before") / self.target)).alias("into"), F.lit(1).alias("pieces"))
        split = shards.where(large).select("shard", "run", "bytes", F.col("shard").alias("into"), F.least(F.col("rows"), F.ceil(F.col("bytes") / self.target)).cast("int").alias("pieces"))
        runs = merged.unionByName(split)
        sizes = runs.groupBy("into").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("size"), F.min("shard").alias("leads"), F.max("pieces").alias("pieces"))
        sizes = sizes.where((F.col("pieces") > 1) | (F.col("members") >= self.fanout) | ((F.col("members") > 1) & (F.col("size") >= FULL * self.target)))
        in_order = Window.orderBy("leads", "into")
        sizes = sizes.withColumn("sooner", F.sum("size").over(in_order) - F.col("size")).withColumn("first", F.sum("pieces").over(in_order) - F.col("pieces"))
        whole = F.broadcast(shards.agg((F.sum("bytes") / STEPS).alias("most")))
        chosen = sizes.join(whole).where((F.col("sooner") <= F.col("most")) & (F.col("first") < RUNS))
        return runs.drop("pieces").join(chosen.select("into", "first", "pieces"), "into").select("shard", "run", "first", "pieces")

    def compact(self) -> int:
        """Merges similarly sized shards and splits large ones, one step; returns the version then current."""
        base = self.version()
        plan = durable(self.plan(base))
        targets = plan.agg(F.max(F.col("first") + F.col("pieces"))).first()[0]
        if not targets:
            return base
        runs = [r[0] for r in plan.select("run").distinct().collect()]
        moved = self._data(runs).join(broadcast_if_small(plan.drop("run")), "shard").select("row", "_bytes", (F.col("first") + F.pmod("i", "pieces")).cast("int").alias("to"))
        with self._announced() as run:
            moved.repartitionById(int(targets), "to").select("row", "_bytes").write.option("compression", "zstd").parquet(f"{self.root}/data/run={run}")
            return self._commit(self.manifest(base).join(plan.select("shard"), "shard", "left_anti").unionByName(self._stats(run)), base)

    def vacuum(self) -> None:
        """Deletes what the newest version no longer names: whole runs, then single shards of the others; readers of older versions must be done.

        Runs that are being written stay. What is there is listed first, then what is announced, then what is
        committed: a run that is neither announced nor committed by then had ended before the listing, or never will.
        """
        found = self._listed("data")
        writing = {s.getPath().getName() for s in self._listed("writing") if s.getModificationTime() > (time.time() - ABANDONED) * 1000}
        live = self.manifest()
        used = {r[0] for r in live.select("run").distinct().collect()}
        left = []
        for run in found:
            name = run.getPath().getName().removeprefix("run=")
            if name in used:
                left.append(run.getPath().toString())
            elif name not in writing:
                self._fs.delete(run.getPath(), True)
        if left:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(left)
            shards = files.select("path", F.regexp_extract("path", r"/(run=[0-9a-f]{32}/.*)$", 1).alias("shard"))
            for r in shards.join(live.select("shard"), "shard", "left_anti").select("path").toLocalIterator():
                self._fs.delete(self._path(r[0]), False)

    def _listed(self, folder: str) -> list:
        at = self._path(f"{self.root}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: (row, _bytes, shard, tier, rows, bytes)."""
        m = self.manifest(version)
        data = self._data([r[0] for r in m.select("run").distinct().collect()])
        return data.drop("i").join(broadcast_if_small(m.select("shard", "tier", "rows", "bytes")), "shard")


def shard(docs: DataFrame, root: str, arrivals: int = 4, target: int = TARGET, arrival: int = ARRIVAL, fanout: int = FANOUT) -> tuple[ShardStore, int]:
    """Appends ``docs`` as ``arrivals`` batches (by hash), compacts until nothing merges, and drops what is superseded."""
    store = ShardStore(docs.sparkSession, root, docs.schema, target, arrival, fanout)
    version = store.append(docs, F.pmod(F.xxhash64("text", "doc_id"), F.lit(arrivals)).cast("int"), arrivals)
    while (new := store.compact()) != version:
        version = new
        store.vacuum()
    return store, version


def sharded(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as stored in a new store in the shared folder, with the shard that each is in (``shard``, with underscores in front where that name is taken)."""
    store, version = shard(docs, f"{shared_dir(docs.sparkSession)}/crawlspark/shards-{uuid.uuid4().hex}", **settings)
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    return store.read(version).select("row.*", F.col("shard").alias(name))
