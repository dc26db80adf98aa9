"""Mixing sources to target weights without sorting documents.

Method: hash-threshold histograms. Targets come from water-filling over the table of
source sizes. A source that needs the share ``q = target / size`` takes every document
``floor(q)`` times, and once more each document whose hash lies under a threshold. The
threshold is found level by level: words are summed by source and hash bucket, the
bucket in which the running sum crosses the budget is the boundary, and only its
documents are summed again by their next hash digits. The last level decides each
remaining hash value by whether taking it brings the sum nearer to the budget.

Defined cases: null text and texts without words have size 0 and take 0; the null source
is a source of its own, after all others; a source of size 0 gets target 0; rows of one
source with the same id (null too) share one hash value and are taken together; an empty
table gives no rows. Tables of sources (one row each, targets) are planned by windows over
all of them; a source's own window runs over the 2**12 sums of a level at most.
Sources are numbered by code point. The hash is MD5 of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, hash01, packed, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
DIGITS, LEVELS = 12, 5  # 2**12 buckets a level; five levels use all 60 bits of the hash


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, no source above ``cap`` times its size.

    Sources fill up in the order of cap / weight; the first one that need not fill up
    fixes the level for all that follow. The windows run over one row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("i", F.row_number().over(every) - 1)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "i")
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = numbered.withColumn("level", level).withColumn("fits", cap * F.col("source_size") >= F.col("level") * F.col("weight"))
    final = F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("i"), F.col("level")))).over(whole)["level"]
    return levelled.withColumn("final", final).select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("final") * F.col("weight"), F.lit(float(cap)) * F.col("source_size"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, limit: documents whose hash is below ``limit`` together come nearest to the budget from its crossing."""
    found, open_ = None, budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("bigint").alias("low"))
    for level in range(LEVELS):
        width = 2 ** (DIGITS * (LEVELS - 1 - level))
        open_side = broadcast_if_small(open_.withColumnRenamed("source", "s"))
        inside = sized.join(open_side, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * 2**DIGITS))
        hist = inside.groupBy("source", "budget", (F.floor(F.col("h") / width) if width == 1 else F.expr(f"h div {width}")).cast("bigint").alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        w = Window.partitionBy("source").orderBy("b")
        crossing = hist.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n")).where("upto > budget and before <= budget")
        crossing = durable(crossing.select("source", F.col("b"), "n", "docs", (F.col("budget") - F.col("before")).alias("left")))
        last = F.lit(level == LEVELS - 1)
        done = crossing.where(last | (F.col("docs") == 1)).select("source", ((F.col("b") + F.when(2 * F.col("left") >= F.col("n"), 1).otherwise(0)) * width).alias("limit"))
        found = done if found is None else found.unionByName(done)
        open_ = crossing.where(~last & (F.col("docs") > 1)).select("source", F.col("left").alias("budget"), (F.col("b") * width).alias("low"))
        if not open_.take(1):
            break
    return found


def _measured(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """The size and the hash that decide how often a row is taken."""
    return F.size(words(text)).cast("bigint"), hash01(doc_id)


def _copies(size: Column, h: Column) -> Column:
    """How often a row is taken, by the columns ``whole`` and ``limit`` of its source's plan."""
    return F.when(size > 0, F.col("whole") + F.when(h < F.coalesce(F.col("limit"), F.lit(0)), 1).otherwise(0)).otherwise(0).cast("int")


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """s, source_size, target, whole, limit: one row per source; ``sized``: source, size, h (read several times, so durable)."""
    sizes = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    goal = durable(targets(sizes, weights, share, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")))
    budgets = goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")).where("budget > 0")
    limits = thresholds(sized, budgets)
    return durable(goal.join(limits.withColumnRenamed("source", "l"), F.col("source").eqNullSafe(F.col("l")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "limit"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document."""
    size, h = _measured(F.col("text"), F.col("doc_id"))
    sized = durable(docs.select("doc_id", "source", size.alias("size"), h.alias("h")))
    by_source = broadcast_if_small(plan(sized, weights, share, cap))
    copies = _copies(F.col("size"), F.col("h"))
    return sized.join(by_source, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: each row as many times as ``mix`` takes it (rows without words: never).

    A row's own source, size and hash decide, so with the plan broadcast no document is shuffled.
    """
    size, h = _measured(F.col("row.text"), F.col("row.doc_id"))
    rows = packed(docs).select("row", F.col("row.source").alias("source"), size.alias("size"), h.alias("h"))
    by_source = broadcast_if_small(plan(durable(rows.select("source", "size", "h")), weights, share, cap))
    taken = rows.join(by_source, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies(F.col("size"), F.col("h"))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
