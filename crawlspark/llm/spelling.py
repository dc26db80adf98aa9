"""Spelling variants: words one edit apart, by an errata trie.

Method: the words' trie is decomposed into heavy paths: of the edges that leave a node,
the one with most words below is heavy, the others are light. Each light subtree is merged,
with one character skipped or replaced, into what hangs beside it at its node:

* its first character replaced by the heavy one, into the heavy subtree;
* its first character replaced by any, into the other light subtrees;
* its first character skipped, into the node itself;
* the heavy character put before it, into the heavy subtree (which skips its own first one).

Terminals that coincide are words one edit apart. A word lies under at most log2(words)
light edges (the smaller side is always the one that is merged), so at most four times as
many errata are made of it, and every pair is found once: an inserted character counts at
the end of a run of its like.

On Spark a node is the 64-bit hash of its prefix. (Two prefixes that share a hash only share
a choice of heavy edge, and any choice gives the same pairs.) Edges are counted by a
grouping, the heavy one is chosen among the at most 91 edges of a node, and errata are
strings joined with the words, or grouped where any light subtree may match (a group holds
one word for each letter of the alphabet). Edges near the root lie on the paths of very many words: those with
over 1 / ``HOT`` of all path steps number at most ``HOT``, and go to the tasks as one bounded
table; the others are joined by a shuffle.

Defined cases: null texts have no words; a null id is the empty string in front of the
colon; rows that repeat an id and text count again; ties of n go to the least word by code
points; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, durable, keep, scratch

LEAST_LENGTH, LEAST_COUNT = 5, 3
SKIPPED = 97  # one of so many (document, word) pairs loses a letter
HOT = 20_000
HELD, STEPS = 300_000, 50_000  # words that a task counts, and steps that it makes, before it hands them on
MODULUS, FACTOR = (1 << 61) - 1, 1_000_003

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def spelled(doc_id: str, run: str) -> str:
    """The run lower-cased (A-Z only), without one letter where its hash with the document says so."""
    low = run.translate(_LOWER)
    h = crc32(f"{doc_id}:{low}".encode())
    if h % SKIPPED:
        return low
    at = h % len(low)
    return low[:at] + low[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of at least ``LEAST_LENGTH`` letters that occurs ``LEAST_COUNT`` times or more."""
    run_re, least, held, spell, schema = _RUN, LEAST_LENGTH, HELD, spelled, pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for run, n in Counter(run_re.findall(text.as_py() or "")).items():
                    if len(run) >= least and len(word := spell(doc_id, run)) >= least:
                        total[word] += n
                if len(total) > held:
                    yield handed()
        yield handed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def path_steps(words: DataFrame) -> DataFrame:
    """(node, edge, depth, id) for every step of a word's path; the edge of its end is the empty string and ``id`` stands for the word.

    Hashes run along the word and the word itself isn't repeated, so a long word costs as much as it is long.
    """
    modulus, factor, full, schema = MODULUS, FACTOR, STEPS, pa.schema([("node", pa.int64()), ("edge", pa.string()), ("depth", pa.int32()), ("id", pa.binary())])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, edges, depths, ids = [], [], [], []

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((nodes, edges, depths, ids), schema, strict=True)], schema=schema)
            for x in (nodes, edges, depths, ids):
                x.clear()
            return out

        for batch in batches:
            for id_, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = 1
                for depth, letter in enumerate((*word, "")):
                    nodes.append(h)
                    edges.append(letter)
                    depths.append(depth)
                    ids.append(id_)
                    if letter:
                        h = (h * factor + ord(letter)) % modulus
                    if len(nodes) == full:
                        yield handed()
        yield handed()

    return words.select("id", "word").mapInArrow(stepped, "node bigint, edge string, depth int, id binary")


def trie_edges(words: DataFrame) -> DataFrame:
    """(node, edge, heavy, size, light) of every edge of the nodes with several edges; ``size`` words lie below it."""
    edges = path_steps(words).groupBy("node", "edge").agg(F.count(F.lit(1)).alias("size"))
    nodes = edges.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("size"), F.col("edge"))), asc=False).alias("all"))
    several = nodes.where(F.size("all") > 1).select("node", F.col("all")[0]["edge"].alias("heavy"), F.posexplode("all").alias("rank", "one"))
    return several.select("node", F.col("one.edge").alias("edge"), "heavy", F.col("one.size").alias("size"), (F.col("rank") > 0).alias("light"))


def errata(words: DataFrame) -> DataFrame:
    """(word, n, kind, key): each word under each of its light edges with one character skipped or replaced."""
    words = words.withColumn("id", F.unhex(F.md5("word")))
    edges = durable(trie_edges(words))
    steps = edges.agg(F.sum("size")).first()[0] or 0
    hot = F.col("size") > steps / HOT  # the sizes add up to the steps, so these are at most HOT
    paths = path_steps(words)
    crowded = broadcast_if_small(edges.where(hot).drop("size"))
    lit = paths.join(crowded.where("light").drop("light"), ["node", "edge"])
    rest = paths.join(crowded.select("node", "edge"), ["node", "edge"], "left_anti").join(edges.where(~hot & F.col("light")).select("node", "edge", "heavy"), ["node", "edge"])
    before, after = F.substring("word", F.lit(1), F.col("depth")), F.substring("word", F.col("depth") + 2, F.length("word"))
    real, has_heavy = F.col("edge") != "", F.col("heavy") != ""
    kinds = [
        ("replaced", real & has_heavy, F.concat(before, "heavy", after)),
        ("any", real, F.concat(before, F.lit("*"), after)),
        ("skipped", real & ~F.startswith(after, F.col("edge")), F.concat(before, after)),
        ("put", has_heavy, F.concat(before, "heavy", "edge", after)),
    ]
    made = F.array(*[F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"))) for kind, when, key in kinds])
    return lit.unionByName(rest).join(words, "id").select("word", "n", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("word", "n", "e.kind", "e.key")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, in both directions; ``words`` is a table of (word, n)."""
    made = durable(errata(words))
    met = made.where("kind <> 'any'").join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    both = F.explode(F.array(F.struct(F.col("word"), F.col("key").alias("near"), F.col("key_n").alias("near_n")), F.struct(F.col("key").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    beside = made.where("kind = 'any'").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("all")).where(F.size("all") > 1)  # at most one for each letter
    one = beside.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.word <> b.word")
    return met.select(both.alias("p")).select("p.*").unionByName(one.select("a.word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table of (word, form): the form at the end of the chain, by pointer doubling.

    n doubles at least from a word to its form, so a chain has at most 63 steps and the loop at most 6 rounds.
    """
    at = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while at.where("open").limit(1).count():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("more"))
        moved = at.where("open").join(broadcast_if_small(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("more", F.lit(False)).alias("open"))
        before, at = at, durable(at.where("not open").unionByName(moved))
        discard(before)
    return at.drop("open")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    with scratch():
        words = durable(word_counts(docs))
        best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
        near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        of = lambda c: F.when(-F.col("best.minus") >= 2 * F.col("n"), c)
        formed = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), of(F.col("best.near")).alias("form"), of(-F.col("best.minus")).alias("form_n")))
        ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
        return keep(durable(formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")))
