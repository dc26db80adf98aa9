"""Cache freshness, upserts, retries and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(status: Column, cached_modified: Column, modified: Column, cached_sha: Column, body: Column, cached_data: Column) -> Column:
    """What to do with a fetched page, in the crawl's order of decisions."""
    fresh = F.coalesce(cached_modified >= modified, F.lit(False))
    same = F.coalesce(cached_sha == F.sha1(body), F.lit(False))
    return (
        F.when((status == 304) | fresh | same, F.when(cached_data.isNotNull() & body.isNull(), "restored").otherwise("up_to_date"))
        .when(F.coalesce(F.length(body), F.lit(0)) == 0, F.when(cached_data.isNotNull(), "restored").otherwise("empty"))
        .otherwise("written")
    )


def freshness(fetched: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """``fetched`` (status, modified, body) left-joined to ``cache`` (cached_modified, cached_sha, cached_data) with ``outcome``."""
    return fetched.join(cache, keys, "left").withColumn("outcome", outcome(*[F.col(c) for c in ("status", "cached_modified", "modified", "cached_sha", "body", "cached_data")]))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def retry_set(log: DataFrame, key: str = "url") -> DataFrame:
    """Keys that failed without being fatal, never succeeded since and are no seeds; ``log``: key, ok, fatal, seed."""
    return log.groupBy(key).agg(F.bool_or(~F.col("ok")).alias("failed"), F.bool_or("ok").alias("done"), F.bool_or("fatal").alias("dead"), F.bool_or("seed").alias("start")).where("failed and not done and not dead and not start").select(key)


def retried(log: DataFrame, key: str = "url") -> DataFrame:
    """Keys that failed at first and are no longer failed: their retry succeeded; ``log``: key, ok."""
    return log.groupBy(key).agg(F.bool_or(~F.col("ok")).alias("failed"), F.bool_or("ok").alias("done")).where("failed and done").select(key)


def any_updated(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: whether any key of ``new`` is missing from ``old`` or has another value there."""
    before = old.select(*keys, F.col(value).alias("_old"))
    changed = ~F.col(value).eqNullSafe(F.col("_old"))
    return new.join(before, keys, "left").agg(F.coalesce(F.bool_or(changed), F.lit(False)).alias("updated"))


def with_servers(urls: DataFrame, servers: DataFrame) -> DataFrame:
    """``urls`` (domain) with what is known of their servers (domain, accept_ranges): ``accepts_ranges`` is false where nothing is."""
    known = servers.select("domain", (F.lower("accept_ranges") == "bytes").alias("_r"))
    return urls.join(known, "domain", "left").withColumn("accepts_ranges", F.coalesce("_r", F.lit(False))).drop("_r")


def with_headers(cache: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """``cache`` whose map ``headers`` takes up the newly seen ones (a seen header replaces the kept one)."""
    seen = headers.select(*keys, F.col("headers").alias("_new"))
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("headers", none), F.coalesce("_new", none)
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return cache.join(seen, keys, "left").withColumn("headers", merged).drop("_new")


def part_totals(parts: DataFrame) -> DataFrame:
    """url, percent, rate, eta over the parts (url, n_bytes, done_bytes, seconds) of each file; eta is null where nothing came yet."""
    sums = parts.groupBy("url").agg(F.sum("n_bytes").alias("n"), F.sum("done_bytes").alias("d"), F.max("seconds").alias("s"))
    rate = F.when(F.col("s") > 0, F.col("d") / F.col("s"))
    return sums.select("url", F.when(F.col("n") > 0, 100.0 * F.col("d") / F.col("n")).alias("percent"), rate.alias("rate"), F.when(rate > 0, (F.col("n") - F.col("d")) / rate).alias("eta"))


def range_parts(length: Column, parts: Column) -> Column:
    """array<struct<part, start, end>> of a byte range in equal parts; the last gets the rest; ends are inclusive."""
    size = F.floor(length / parts)
    return F.transform(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1), lambda i: F.struct(i.alias("part"), (i * size).alias("start"), (F.when(i == parts - 1, length).otherwise((i + 1) * size) - 1).alias("end")))


def reassembled(chunks: DataFrame, key: str, start: str, data: str) -> DataFrame:
    """One row per key with its chunks joined in order of their start."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(data).alias("d"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c["d"]), "").alias("data"))
