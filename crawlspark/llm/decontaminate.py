"""Benchmark decontamination: short test items inside long documents.

Method: size-partitioned MinHash containment search. An item's set is its distinct
five-word shingles (lower-cased letter-and-digit words; an item of fewer words is one
shingle of its own length). Items are partitioned by set size into powers of two; in a
partition of at most ``u`` shingles the signature is the ``floor((1 - threshold) * u) + 1``
shingles with the least hashes. An item that a document contains to ``threshold`` misses
at most ``(1 - threshold) * size`` shingles, so at least one signature shingle is in the
document: the search loses nothing. Each shingle of a document probes the signatures;
hits are verified by exact containment of the shingles themselves.

A broadcast of the signatures is used up to ``BROADCAST_ROWS`` signature rows, then a
shuffle join; the same holds for the candidates on the way back to the texts.

Defined cases: null or wordless texts contain nothing; null or wordless items and items
without id are ignored; a document without id cannot be named, so it is not reported (and
``clean`` keeps it); repeated rows of an id are reported once, with the best containment.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, let, packed, shingle_hashes

WIDTH, THRESHOLD = 5, 0.8


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def shingles(words: Column, width: Column | int) -> Column:
    """The distinct shingles of ``width`` words as strings."""
    width = F.lit(width) if isinstance(width, int) else width
    return let(words, lambda w: F.when((F.size(w) >= width) & (width > 0), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))).otherwise(F.array().cast("array<string>")))


def item_sets(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, key (of the text), width, its shingles and their number; items without id or words are left out."""
    t = items.where("item_id is not null").select("item_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates(["item_id", "key"])
    t = t.withColumn("width", F.least(F.lit(width), F.size("w")))
    return t.withColumn("set", shingles(F.col("w"), F.col("width"))).select("item_id", "key", "width", "w", "set", F.size("set").alias("n"))


def signatures(sets: DataFrame, widths: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """item_id, key, h: the signature of each item, sized by its partition."""
    hashes = F.array_distinct(F.coalesce(*[F.when(F.col("width") == n, shingle_hashes(F.col("w"), n)) for n in widths]))
    upper = F.pow(F.lit(2), F.floor(F.log2(F.size("hashes").cast("double"))) + 1) - 1
    keep = (F.floor((1 - F.lit(threshold)) * upper + 1e-9) + 1).cast("int")
    return sets.withColumn("hashes", hashes).select("item_id", "key", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), keep)).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document and item it contains to ``threshold``."""
    assert 0 < threshold <= 1 and floor(width) == width
    sets = durable(item_sets(items, width))
    widths = sorted(r[0] for r in sets.select("width").distinct().collect())  # at most ``width`` numbers
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    probes = texts.select("doc_id", F.explode(let(tokens(F.col("text")), lambda w: F.array_distinct(F.concat(*[shingle_hashes(w, n) for n in widths])))).alias("h"))
    marks = durable(signatures(sets, widths, threshold))
    pairs = durable(probes.join(broadcast_if_small(marks), "h").groupBy("doc_id", "item_id", "key").agg(F.count(F.lit(1)).alias("hits")))
    held = texts.join(broadcast_if_small(durable(pairs.select("doc_id").distinct())), "doc_id")
    pairs = pairs.join(broadcast_if_small(sets.select("item_id", "key", "width", "set", "n")), ["item_id", "key"])
    own = held.select("doc_id", tokens(F.col("text")).alias("words"))
    checked = pairs.join(own, "doc_id").withColumn("shared", F.size(F.array_intersect("set", shingles(F.col("words"), F.col("width")))).cast("bigint"))
    found = checked.where(F.col("shared") >= F.lit(threshold) * F.col("n") - 1e-9).select("doc_id", "item_id", F.col("shared").alias("n_shared"), F.col("n").cast("bigint").alias("n_item"), (F.col("shared") / F.col("n")).alias("containment"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b")).select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    bad = durable(contaminated(docs, items, width, threshold).select("doc_id").distinct())
    return packed(docs).join(broadcast_if_small(bad), F.col("row.doc_id") == F.col("doc_id"), "left_anti").select("row.*")
