"""URL filters by hash-prefix lookup.

Method: each URL becomes its host-suffix x path-prefix expressions. An expression is
looked up by the first four bytes of its SHA-256 (an equi-join); a hit is confirmed on
the whole digest, and the longest confirmed rule decides (among equal lengths the one
with the longer host, then block before allow).

Path prefixes are those that end in ``/`` plus, where the rule table has paths that do
not end in ``/``, prefixes of exactly those lengths, so any rule path is met; prefixes
longer than any rule's path are left out. Rules are broadcast if they are few (see
``broadcast_if_small``); beyond that both sides are shuffled on the hash prefix, and the
URL side of a common prefix is split by AQE. Only confirmed hits go on: the best rule of
each (host, path) is a combinable maximum and is joined back to the rows.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule
and is allowed; a URL that fits none is allowed (``default``). A URL without path does
not start with ``/``, so it fits no rule. Rows keep their multiplicity, null ids too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small

PREFIX_BYTES = 4


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, ``host/path``) with the columns that the lookup needs."""
    rows = spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")
    return keyed_rules(rows)


def keyed_rules(rules: DataFrame) -> DataFrame:
    digest = F.sha2("rule", 256)
    return rules.where("rule is not null and verdict is not null").select("verdict", "rule", F.substring(digest, 1, 2 * PREFIX_BYTES).alias("prefix"), digest.alias("digest"))


def expressions(host: Column, path: Column, lengths: list[int], longest: int) -> Column:
    """Every ``host suffix + path prefix`` of one URL as an array of strings; no prefix is longer than ``longest``."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.substring(path, 1, longest), "/")
    slashed = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    exact = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    paths = F.array_distinct(F.concat(slashed, exact))
    return F.when((host == "") | ~path.startswith("/"), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``. ``rules``: see ``rule_table``."""
    path_len = F.length("rule") - F.instr("rule", "/") + 1
    lengths = sorted(r[0] for r in rules.where("rule not like '%/'").select(path_len.alias("n")).distinct().collect())
    longest = rules.agg(F.max(path_len)).first()[0] or 0
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    looked = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths, longest)).alias("expr"))
    looked = looked.withColumn("full", F.sha2("expr", 256)).withColumn("prefix", F.substring("full", 1, 2 * PREFIX_BYTES))
    hits = looked.join(broadcast_if_small(rules), "prefix").where(F.col("full") == F.col("digest"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("h"), (F.col("verdict") == "block").alias("b"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))
    ruled = hits.groupBy("host", "path").agg(best.alias("best"))
    return urls.join(ruled, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
