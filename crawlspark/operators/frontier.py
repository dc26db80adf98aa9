"""The frontier: priorities, limits and traversal of the link graph to a fixpoint."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, durable, passed_on, scratch


#: The redirects that a task joins, so that its memory stays as tables grow
ROWS = 250_000


def parse_priorities(text: str) -> dict[str, int]:
    """``key+n,key-n`` with n from -5 to 5; keys are lower-cased, other parts are ignored."""
    found = {}
    for part in (text or "").split(","):
        m = re.fullmatch(r"\s*(.+?)\s*([+-]\d+)\s*", part)
        if m and -5 <= int(m[2]) <= 5:
            found[m[1].lower()] = int(m[2])
    return found


def priority(parent_generation: Column, is_webpage: Column, extension: Column, domain: Column, by_extension: str = "", by_server: str = "") -> Column:
    """Parent's generation less one for a web page, less the boosts; smaller is sooner."""
    p = parent_generation - F.when(is_webpage, 1).otherwise(0)
    for key, n in parse_priorities(by_extension).items():
        p = p - F.when(F.lower(extension) == "." + key.lstrip("."), n).otherwise(0)
    servers = [F.when(F.instr(F.lower(domain), key) > 0, n) for key, n in parse_priorities(by_server).items()]
    return p - F.coalesce(*servers, F.lit(0))


def max_files(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in order: a distributed top-k, not a global window."""
    return df.orderBy(*order).limit(limit)


def slice_links(df: DataFrame, source: str, ordinal: str, start: int = 0, end: int = -1, compat: bool = False) -> DataFrame:
    """Links ``start .. end`` of each source; a negative ``end`` counts from the end (``compat``: the quirk that -2 goes one beyond)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(source))
    stop = F.lit(end) if end >= 0 else (n - (end + 1) if compat else n + end + 1)
    return df.withColumn("_n", n).withColumn("_stop", stop).where((F.col(ordinal) >= start) & (F.col(ordinal) < F.col("_stop"))).drop("_n", "_stop")


def bfs(seeds: DataFrame, edges: DataFrame, max_generation: int | None = None, contexts: list[str] | None = None) -> DataFrame:
    """(node, generation) for all that can be reached: generation is that of the nearest seed plus one per hop.

    ``seeds``: node; ``edges``: src, dst and, with ``contexts``, context. Each hop is a join of the last
    generation with the edges less what is known, and a written table; it ends when a hop finds nothing.
    """
    if contexts is not None:
        edges = edges.where(F.col("context").isin(*contexts))
    last = durable(seeds.select("node", F.lit(0).alias("generation")).distinct())
    known, hop = last, 0
    while max_generation is None or hop < max_generation:
        hop += 1
        reached = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        last = durable(reached.join(known, "node", "left_anti").withColumn("generation", F.lit(hop)))
        if not last.take(1):
            break
        known = known.unionByName(last)
    return known


def redirect_chains(redirects: DataFrame, max_hops: int = 20) -> DataFrame:
    """(url, target, hops, loop, cut) by following redirects(src, dst) at most ``max_hops`` times; src is unique.

    ``loop``: the target was passed before; ``cut``: the chain goes on beyond ``max_hops``.
    """
    # each hop is joined once and written; a task sorts (url, target, path) and no aggregate of what made the redirects
    step = durable(redirects.select(F.col("src").alias("s"), F.col("dst").alias("d")))
    parts = max(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-step.count() // ROWS))
    at = step.select(F.col("s").alias("url"), F.col("d").alias("target"), F.lit(1).alias("hops"), F.array("s").alias("path"))
    done = None
    for hop in range(1, max_hops + 1):
        looped = F.coalesce(F.array_contains("path", F.col("target")), F.lit(False))
        dealt = at.repartition(parts, "target").join(step.repartition(parts, "s"), F.col("target") == F.col("s"), "left")
        moved = durable(dealt.select("url", "target", "hops", "path", "d", looped.alias("loop"), (F.col("s").isNull() | looped).alias("last")))
        end = (moved.where("last") if hop < max_hops else moved).select("url", "target", "hops", "loop", (~F.col("last")).alias("cut"))
        done = end if done is None else done.unionByName(end)
        if hop == max_hops:
            break
        at = moved.where("not last").select("url", F.col("d").alias("target"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("target")).alias("path"))
        if not at.take(1):
            break
    return done


def _doubled(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((url, target, hops) of those whose chain ends, (url, dst) of the others) for step(url, dst), url unique: pointers double their reach until no more ends are found."""
    at = durable(step.select("url", F.col("dst").alias("target"), F.lit(1).cast("bigint").alias("hops"), F.lit(False).alias("done")))
    left = at.count()
    while left:
        ahead = at.select(F.col("url").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"), F.col("done").alias("ended"))
        moved = at.where("not done").join(ahead, "target", "left").select("url", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("ended", F.lit(True)).alias("done"))
        before, at = at, durable(at.where("done").unionByName(moved))
        discard(before)
        was, left = left, at.where("not done").count()
        if left == was:
            break
    return at.where("done").select("url", "target", "hops"), step.join(at.where("not done").select("url"), "url", "left_semi")


def contracted(redirects: DataFrame) -> DataFrame:
    """(url, target, hops, loop, cycle) of every src of redirects(src, dst), src unique, in as many rounds as the longest chain has binary digits.

    A chain that ends: its last URL and the redirects to it. A chain that doesn't: ``loop``, the first URL of its cycle (itself
    on the cycle, after 0 redirects) and the length of the cycle. Cycles are what is left of repeated images; their length is
    counted by their least URL, which pointers carry around.
    """
    with scratch():
        step = durable(redirects.select(F.col("src").alias("url"), "dst"))
        ended, looping = _doubled(step)
        ended, looping = durable(ended), durable(looping)
        plain = ended.select("url", "target", "hops", F.lit(False).alias("loop"), F.lit(None).cast("bigint").alias("cycle"))
        if not looping.take(1):
            return passed_on(durable(plain))
        image, size = looping, -1
        while True:
            reached = durable(image.select(F.col("dst").alias("url")).distinct())
            if reached.count() == size:
                break
            size = reached.count()
            image = durable(image.join(image.select(F.col("url").alias("dst"), F.col("dst").alias("next")), "dst").select("url", F.col("next").alias("dst")))
        on = durable(looping.join(reached, "url", "left_semi").select("url", "dst", F.least("url", "dst").alias("low")))
        ring = on
        while True:
            ahead = on.select(F.col("url").alias("dst"), F.col("dst").alias("next"), F.col("low").alias("low2"))
            on = durable(on.join(ahead, "dst").select("url", F.col("next").alias("dst"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
            if not on.where("changed").take(1):
                break
        cycles = durable(on.join(on.groupBy("low").agg(F.count(F.lit(1)).alias("cycle")), "low").select(F.col("url").alias("target"), "cycle"))
        tails, _ = _doubled(looping.join(ring.select("url"), "url", "left_anti"))
        looped = tails.unionByName(cycles.select(F.col("target").alias("url"), "target", F.lit(0).cast("bigint").alias("hops"))).join(cycles, "target")
        return passed_on(durable(plain.unionByName(looped.select("url", "target", "hops", F.lit(True).alias("loop"), "cycle"))))


def redirects_followed(chains: DataFrame, repeats: int = 4, most: int = 20) -> DataFrame:
    """``contracted`` chains with ``followed`` (redirects until it ends or is refused) and ``refused``.

    A redirect is refused that leads to a URL met ``repeats`` times before, or when ``most`` different ones were met.
    """
    before = F.greatest(F.col("hops") - 1, F.lit(0))  # different URLs that are met ahead of the cycle
    loops = F.when(before + F.col("cycle") >= most, F.lit(most)).otherwise(before + repeats * F.col("cycle"))
    followed = F.when(F.col("loop"), loops).otherwise(F.least("hops", F.lit(most))).cast("bigint")
    return chains.withColumns({"followed": followed, "refused": F.col("loop") | (F.col("hops") > most)})
