"""Sources and sinks of crawl tables, all through Spark's readers and writers."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links, urls
from .scratch import durable


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fetch(frontier: DataFrame, pages_: DataFrame, key: str = "full_url") -> DataFrame:
    """The offline fetch: the frontier left-joined to a table of pages by URL; ``html`` is null where there is none."""
    return frontier.join(pages_.select(F.col("url").alias(key), "html"), key, "left")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines are skipped and schemes added."""
    return spark.read.text(path).where(F.trim("value") != "").select(urls.fix_seed(F.trim("value")).alias("url"))


def robots_files(spark: SparkSession, path: str) -> DataFrame:
    """(host, robots_txt, http_status) from files named ``<host>.txt``."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("host"), F.col("value").alias("robots_txt"), F.lit(200).alias("http_status"))


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """The distinct links of RSS files in order."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.posexplode(links.feed_links(F.col("value"))).alias("ordinal", "url"))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a folder as (path, name, content)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file of settings (junk domains, patterns), without blank ones and comments."""
    found = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return [r[0] for r in found.select(F.trim("value")).limit(100_000).collect()]


def clash_free(df: DataFrame, folder: tuple[str, ...] = ("domain", "directory"), name: str = "filename", order: str = "url", slices: int = 64) -> DataFrame:
    """``df`` with ``saved_name``: the first row of a name in its folder, by ``order``, keeps it; later ones get .1, .2, ...

    Rows are dealt by ranges of (folder, name, order) and numbered in each range from the count of the ranges before, so a name that a
    third of all rows bear is not sorted in one task.
    """
    keys = [*folder, name]
    sliced = durable(df.repartitionByRange(slices, *keys, order).withColumn("_slice", F.spark_partition_id()))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most ``slices`` rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_before")
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order)) - 1 + F.col("_before")
    joined = sliced.join(before, same).withColumn("_nth", nth)
    return joined.withColumn("saved_name", F.when(F.col("_nth") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("."), F.col("_nth").cast("string")))).drop("_slice", "_s", "_before", "_nth", *[f"_k{i}" for i in range(len(keys))])


def repaired_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with ``saved_path``: a file whose path is also a folder of another file moves into it as index.html."""
    parts = F.split(F.col(path), "/")
    folders = df.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_folder"), F.size(parts).alias("_n")).where("_n > 1").select("_folder").distinct()
    return df.join(folders, F.col(path) == F.col("_folder"), "left").withColumn("saved_path", F.when(F.col("_folder").isNotNull(), F.concat(F.col(path), F.lit("/index.html"))).otherwise(F.col(path))).drop("_folder")


def write_pages(df: DataFrame, path: str) -> None:
    """Pages with a body, by domain, under names that are free of clashes (``domain``, ``directory``, ``filename``, ``url``, ``html``)."""
    named = clash_free(df.where(F.length("html") > 0))
    named.write.mode("overwrite").partitionBy("domain").parquet(path)


def write_cache(cache: DataFrame, path: str) -> None:
    """The project cache by domain hash, compressed."""
    cache.withColumn("domain_hash", F.md5("domain")).write.mode("overwrite").option("compression", "zstd").partitionBy("domain_hash").parquet(path)


def write_headers(df: DataFrame, path: str) -> None:
    df.where("headers is not null").select("url", F.to_json("headers").alias("headers")).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str, append: bool = False) -> None:
    df.select(F.col(column).cast("string")).write.mode("append" if append else "overwrite").text(path)


def read_cache(spark: SparkSession, path: str, domains: list[str] | None = None) -> DataFrame:
    """The project cache; of some domains only their own folders are read."""
    cache = spark.read.parquet(path)
    if domains is not None:
        cache = cache.where(F.col("domain_hash").isin([hashlib.md5(d.encode()).hexdigest() for d in domains]))
    return cache


def rebuilt(cache: DataFrame) -> DataFrame:
    """path, data: the files of a site as far as the cache holds their data (``url``, ``data``)."""
    held = urls.parsed(cache.where(F.col("data").isNotNull()), F.col("url"), "_u")
    return held.select(urls.full_filename(F.col("_u")).alias("path"), "data")


def cached_headers(cache: DataFrame) -> DataFrame:
    """url, header, value for every header that the cache holds."""
    return cache.where("headers is not null").select("url", F.explode("headers").alias("header", "value"))


def save_session(tables_: dict[str, DataFrame], path: str) -> None:
    """The state of a run as tables under one name, written whole before it is named complete."""
    for name, df in tables_.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(tables_.values())).sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/_complete")


def restore_session(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of the newest complete session under ``root`` (by name); None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName() for s in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
    newest = next((n for n in found if fs.exists(path(f"{root}/{n}/_complete/_SUCCESS"))), None)
    return newest and {n: spark.read.parquet(f"{root}/{newest}/{n}") for n in names}
