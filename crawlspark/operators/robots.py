"""Robots exclusion: parsing and verdicts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let

RULE = "struct<path:string,allow:boolean>"
ENTRY = f"struct<agents:array<string>,rules:array<{RULE}>>"


def parse(text: Column, compat: bool = False) -> Column:
    """Entries of a robots.txt as array<struct<agents, rules>>.

    Only a disallow line completes an entry, so an entry with allow lines alone is dropped.
    An empty disallow allows everything; ``compat`` makes it block everything.
    """
    empty = F.struct(F.array().cast(f"array<{ENTRY}>").alias("done"), F.array().cast("array<string>").alias("agents"), F.array().cast(f"array<{RULE}>").alias("rules"), F.lit(False).alias("whole"))

    def closed(s: Column) -> Column:
        return F.when(s["whole"] & (F.size(s["agents"]) > 0), F.concat(s["done"], F.array(F.struct(s["agents"].alias("agents"), s["rules"].alias("rules"))))).otherwise(s["done"])

    def line(s: Column, raw: Column) -> Column:
        text_ = F.trim(F.regexp_replace(raw, "#.*$", ""))
        key, value = F.lower(F.trim(F.split_part(text_, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(text_, "^[^:]*:", ""))

        def step(x: Column) -> Column:
            fresh = F.size(s["rules"]) > 0
            agent = F.struct(F.when(fresh, closed(s)).otherwise(s["done"]).alias("done"), F.when(fresh, F.array(x["v"])).otherwise(F.concat(s["agents"], F.array(x["v"]))).alias("agents"), F.when(fresh, F.array().cast(f"array<{RULE}>")).otherwise(s["rules"]).alias("rules"), (s["whole"] & ~fresh).alias("whole"))
            allow = (x["k"] == "allow") | ((x["v"] == "") & F.lit(not compat))
            rule = F.struct(s["done"].alias("done"), s["agents"].alias("agents"), F.concat(s["rules"], F.array(F.struct(x["v"].alias("path"), allow.alias("allow")))).alias("rules"), (s["whole"] | (x["k"] == "disallow")).alias("whole"))
            blank = F.struct(closed(s).alias("done"), F.array().cast("array<string>").alias("agents"), F.array().cast(f"array<{RULE}>").alias("rules"), F.lit(False).alias("whole"))
            return F.when(F.trim(raw) == "", blank).when(x["k"] == "user-agent", agent).when(x["k"].isin("allow", "disallow") & (F.size(s["agents"]) > 0), rule).otherwise(s)

        return let(F.struct(key.alias("k"), value.alias("v")), step)

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), empty, line, closed)


def allowed(entries: Column, status: Column, agent: Column, path: Column, compat: bool = False) -> Column:
    """Whether ``agent`` may fetch ``path``; 401 and 403 forbid all (``compat``: allow all), other errors allow all."""
    token = F.lower(F.split_part(agent, F.lit("/"), F.lit(1)))
    mine = F.get(F.filter(entries, lambda e: F.exists(e["agents"], lambda a: (a == "*") | (F.instr(F.lower(a), token) > 0))), 0)
    rule = F.get(F.filter(mine["rules"], lambda r: path.startswith(r["path"])), 0)
    refused = F.lit(compat)
    return F.when(F.coalesce(status, F.lit(200)).isin(401, 403), refused).when(F.coalesce(status, F.lit(200)) >= 400, True).otherwise(F.coalesce(rule["allow"], F.lit(True)))


def apply(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` (with host and path) with ``robots_allowed``; hosts without robots allow all. ``robots``: host, robots_txt, http_status."""
    parsed = robots.select(F.col("host").alias("_host"), parse(F.col("robots_txt")).alias("_entries"), F.col("http_status").alias("_status"))
    joined = urls.join(parsed, F.col("host") == F.col("_host"), "left")
    return joined.withColumn("robots_allowed", F.when(F.col("_host").isNull(), True).otherwise(allowed(F.col("_entries"), F.col("_status"), F.lit(agent), F.col("path")))).drop("_host", "_entries", "_status")
