"""Quality rules whose cutoffs carry a proven limit on the share of good documents they reject.

Method: risk-controlled thresholds. Four badness scores are tried at a fixed grid of
cutoffs in each stratum (language). One half of the labelled documents nominates the
cells (stratum, rule, cutoff) that reject some bad document; the other half, the
holdout, tests each nominee with the exact binomial tail: with ``n`` good holdout
documents of which ``k`` would be rejected, the cell passes if
``P(Binomial(n, risk / n_rules) <= k) <= confidence / nominees``, that is, if the
Clopper-Pearson upper bound is under the rule's share of the risk at a level that
Bonferroni corrects for every nominee. The strictest passing cutoff of a rule is used;
a stratum without a passing cell rejects nothing beyond the base rules. The tail takes
documents for independent, so repeated rows and equal texts of a stratum count once.

Defined cases: null text counts as no words (so ``base_failed``); null language is a
stratum of its own; a document without label only gets judged; several labels of one
document count as good only if all are good; labels of unknown documents and null
labels are ignored; with no labels at all only the base rules act. Rows keep their
multiplicity. Equal texts of a stratum are good only if all their labels are. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, hash01, let, shingle_hashes, words

WINDOW = 5
RISK = 0.05  # of all good documents in a stratum, at most this share is rejected by the learned rules
CONFIDENCE = 0.05  # probability that any stratum breaks the promise
GRID = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share")


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        twice = let(pairs, lambda s: F.filter(s, lambda e, j: same(e, F.get(s, j + 1)) | same(e, F.get(s, j - 1))))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    return let(
        shingle_hashes(tokens, width),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    ).cast("bigint")


def features(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, stratum, the counts of the base rules and the four scores, one row per document."""
    t = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", F.col("lang").alias("stratum"), t.alias("t"), F.md5(t).alias("text_key"), words(F.col("text")).alias("w"), worded.alias("lines")).select(
        "doc_id",
        "stratum",
        "text_key",
        F.size("w").cast("bigint").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w"), width).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, stepped back down (error below 1e-13)."""
    x = n.cast("double") + 10.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - F.log(reduce(lambda a, k: a * (n.cast("double") + k), range(2, 10), n.cast("double") + 1))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact for k under n * p; 1 from there on, where no bound can hold.

    Below the mean the terms fall geometrically from k downward, so 40 standard
    deviations of them hold every digit; the sum never gets longer with k.
    """
    last = F.log(F.lit(p)) * k + F.log(F.lit(1 - p)) * (n - k) + ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    terms = F.least(k, (F.ceil(40 * F.sqrt(n * p)) + 100).cast("bigint"))
    steps = F.when(terms > 0, F.sequence(F.lit(0).cast("bigint"), terms - 1)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, i: let(a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p), lambda t: F.struct(t.alias("term"), (a["total"] + t).alias("total"))),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(last) * total))


def cutoffs(feats: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, grid: tuple = GRID) -> DataFrame:
    """stratum and the certified cutoff of each rule (null: none); one row per stratum with any."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    judged = feats.where("not base_failed").select("doc_id", "stratum", "text_key", *RULES).join(known, "doc_id")
    judged = judged.groupBy("stratum", "text_key").agg(F.min("doc_id").alias("doc_id"), F.bool_and("good").alias("good"), *[F.first(r).alias(r) for r in RULES])
    judged = judged.withColumn("holdout", hash01(F.col("doc_id")) % 2 == 0)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).alias("hit")) for r in RULES for c in grid])
    counts = (
        judged.select("stratum", "good", "holdout", F.explode(cells).alias("c"))
        .groupBy("stratum", "c.rule", "c.cutoff")
        .agg(
            F.count_if(F.col("holdout") & F.col("good")).alias("n"),
            F.count_if(F.col("holdout") & F.col("good") & F.col("c.hit")).alias("k"),
            F.count_if(~F.col("holdout") & ~F.col("good") & F.col("c.hit")).alias("caught"),
        )
        .where("caught > 0")
    )
    counts = durable(counts)
    nominees = counts.agg(F.count(F.lit(1)).alias("nominees"))
    passed = counts.join(F.broadcast(nominees)).where(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= confidence / F.col("nominees"))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``."""
    feats = durable(features(docs))
    found = durable(cutoffs(feats, labels, risk, confidence)).withColumnRenamed("stratum", "s")
    broken = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in RULES])
    return feats.join(broadcast_if_small(found), F.col("stratum").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~broken).alias("kept")
    )
