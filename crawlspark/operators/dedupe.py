"""Exact duplicate elimination by URL and by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_urls(df: DataFrame, key: str = "full_url") -> DataFrame:
    """One row per URL (exact, where the crawler's list of recent hashes was bounded)."""
    return df.dropDuplicates([key])


def content_duplicates(df: DataFrame, body: str, domain: str, order: str) -> DataFrame:
    """``df`` with ``is_dup``: the body was first seen, earlier in ``order``, on this row's own domain.

    The first sight of each body is a combinable minimum, so a body that many pages share makes no large group.
    """
    marked = df.withColumn("_sha", F.sha1(F.coalesce(F.col(body), F.lit(""))))
    first = marked.groupBy("_sha").agg(F.min(F.struct(F.col(order).alias("o"), F.col(domain).alias("d"))).alias("_f"))
    joined = marked.join(first, "_sha")
    return joined.withColumn("is_dup", (F.col(order) > F.col("_f.o")) & F.col(domain).eqNullSafe(F.col("_f.d"))).drop("_sha", "_f")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def already_saved(df: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    return df.join(saved.select(key).distinct(), key, "left_semi")
