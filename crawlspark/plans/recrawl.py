"""Crawls one after the other over a project cache: what is up to date is taken from it, what is new goes into its next version.

The cache is a table (url, modified, sha, data) in ``tables/`` of a folder, and its versions name
the table that counts (``sources.versions``): readers see the version before or the new one whole, and of two
crawls that end at once one commits and the other gets RuntimeError.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache
from ..sources.config import CrawlConfig
from ..sources.scratch import durable
from ..sources.versions import Versions
from .crawl import Crawl, canonical, crawl, one_page

CACHE = "url string, modified timestamp, sha string, data string"

# What became of a URL
FAILED, WRITTEN, UP_TO_DATE, RESTORED, FILTERED = 0, 1, 3, 4, 5


@dataclass(frozen=True)
class Recrawl:
    """``outcomes``: url, code and data of every URL of the crawl's ledger; ``version``: that of the cache it left."""

    crawl: Crawl
    outcomes: DataFrame
    version: int


def read_cache(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The project cache as some version left it (the newest by default); empty before the first."""
    versions = Versions(spark, f"{store}/versions")
    v = versions.newest() if version is None else version
    return spark.read.schema(CACHE).parquet(f"{store}/tables/{versions.text(v)}") if v else spark.createDataFrame([], CACHE)


def outcome_code(status: Column, html: Column, modified: Column, cached: Column, saved: Column, on_disk: Column) -> Column:
    """The code of a fetched URL, given its row of the cache (a struct, null: none).

    Up to date: the server says so (304), or its time isn't later than the cached one, or, where it tells no time, the content's checksum is the cached one.
    What is up to date but no longer on disk is restored from the cached data.
    """
    fresh = (status == 304) | F.when(modified.isNotNull(), cached["modified"] >= modified).otherwise(F.sha1(html) == cached["sha"])
    current = cached.isNotNull() & F.coalesce(fresh, F.lit(False))
    return (
        F.when(current & ~saved, FILTERED)
        .when(current & on_disk, UP_TO_DATE)
        .when(current & cached["data"].isNotNull(), RESTORED)
        .when(html.isNull(), FAILED)
        .when(~saved, FILTERED)
        .otherwise(WRITTEN)
    )


def recrawl(pages: DataFrame, seeds: DataFrame, store: str, config: CrawlConfig = CrawlConfig(), on_disk: DataFrame | None = None, **options) -> Recrawl:
    """A crawl over ``pages`` (url, html, status, modified) with the cache in ``store``, and the cache's next version.

    A page that the server didn't send again (304) is parsed as the cache holds it. ``on_disk`` (url) says which files are still there (all, where it is null);
    ``options`` are those of ``crawl``. Only what is written enters the cache; other rows of it stay.
    """
    spark = pages.sparkSession
    versions = Versions(spark, f"{store}/versions")
    base = versions.newest()
    held = read_cache(spark, store, base)
    named = canonical(pages.select("url", "html", F.col("status").cast("int").alias("status"), F.col("modified").cast("timestamp").alias("modified")))
    sent = one_page(named.select("full_url", "url", "html", "status", "modified"), "full_url").drop("url").withColumnRenamed("full_url", "url")
    known = held.select("url", F.struct("modified", "sha", "data").alias("cached"))
    met = durable(sent.join(known, "url", "left"))
    body = F.when((F.col("status") == 304) | F.col("html").isNull(), F.coalesce("html", "cached.data")).otherwise(F.col("html"))
    done = crawl(met.select("url", body.alias("html"), "status"), seeds, config, **options)
    taken = done.ledger.where("fetched").select("url", "saved")
    seen = met.join(taken, "url")
    if on_disk is not None:
        seen = seen.join(on_disk.select("url").distinct().withColumn("_there", F.lit(True)), "url", "left")
    there = F.lit(True) if on_disk is None else F.coalesce("_there", F.lit(False))
    code = outcome_code(*[F.col(c) for c in ("status", "html", "modified", "cached", "saved")], there)
    outcomes = durable(seen.select("url", code.alias("code"), F.when(F.col("html").isNull() | (code == RESTORED), F.col("cached.data")).otherwise(F.col("html")).alias("data"), "modified"))
    written = outcomes.where(F.col("code") == WRITTEN).select("url", "modified", F.sha1("data").alias("sha"), "data")
    name = uuid.uuid4().hex
    cache.upsert(held, written, ["url"]).write.parquet(f"{store}/tables/{name}")
    version = versions.commit(name, base)
    missing = done.ledger.where("not fetched").select("url", F.lit(FAILED).alias("code"), F.lit(None).cast("string").alias("data"))
    return Recrawl(done, outcomes.drop("modified").unionByName(missing), version)
