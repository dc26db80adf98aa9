"""Personal data by bootstrapped contextual extraction.

Method: spans that fixed expressions find (``KINDS``) are the seeds. Every mention, a seed or any
other text that looks like an identifier, has up to three lexical patterns: the two words before it,
the words on both sides, and the word before it with the shape of the mention. Patterns and
instances (distinct mentioned texts) make a graph, on which Spark scores in turn:

* a pattern, for the kind it has most of: the sum of the scores of its instances of that kind
  over their number plus one; it is trusted from ``TRUST`` on, with ``SUPPORT`` accepted
  instances at least;
* an instance that is no seed: 1 - product of (1 - score) over its trusted patterns; it is accepted from
  ``ACCEPT`` on and then counts, with its score and kind, for the patterns it has elsewhere.

Seeds keep score 1. Scoring ends when no more instances are accepted, after ``ROUNDS`` rounds at the latest
(how far from a seed the method goes). Mentions of accepted instances in a trusted pattern are
added as spans of the pattern's kind. An instance counts once for each pattern, however often it is repeated.

A mention that is no seed: one word with a digit or ``@``, without what precedes its last ``=``,
``:`` or quote (as in ``password=``), opening brackets and closing punctuation, or numbers of digits and signs one space apart; of 5 to 64
characters, and not over a seed. Context is read within 80 characters either side, in small letters, digits as 0.

Seeds are found in time linear in the text (expressions that could start anywhere in a run are
anchored to its start). Offsets are code points.

Defined cases: null text is empty and has no spans; rows keep their multiplicity, and every row gets the spans of
its own text; documents of any id, null too; ties between kinds go to the first of ``KINDS``; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, durable, keep, scratch

KINDS = ("email", "ip", "card", "phone")
TRUST, ACCEPT, SUPPORT, ROUNDS = 0.75, 0.8, 4, 5
REACH, LEAST, MOST = 80, 5, 64

_SPACE = "\\x20\\x09-\\x0D"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MENTION = re.compile(rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+")
_NUMBERS = re.compile(r"[0-9().+/-]+")
_DIGITS, _LETTERS = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+")
_GIVEN, _OPENING, _CLOSING = "=:\"'", "([{<", ".,;:!?)]}>\"'*#%&$"

ROW = "id bigint, doc_id bigint, base array<struct<k:int,start:int,stop:int>>, found array<struct<k:int,start:int,stop:int,instance:bigint,patterns:array<bigint>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of what the fixed expressions find, by kind and start."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            found.append((1, m.start(), m.end()))
    for k, expression, least, most in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in expression.finditer(text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if least <= len(digits) <= most and (k == 3 or luhn(digits)):
                found.append((k, m.start(), m.end()))
    return found


def _number(*parts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _plain(text: str) -> str:
    return _DIGITS.sub("0", text.lower())


def shape(text: str) -> str:
    return _DIGITS.sub(lambda m: f"9{{{len(m[0])}}}", _LETTERS.sub("a", text))


def patterns(text: str, start: int, end: int) -> list[int]:
    """The lexical patterns of a mention; none where nothing stands before it."""
    before, after = _plain(text[max(0, start - REACH) : start]), _plain(text[end : end + REACH])
    left, right = before.split(), (after.split() or [""])[0]
    affix = left.pop() if left and not before[-1].isspace() else ""
    one, two = (["", "", *left])[-1], (["", "", *left])[-2]
    if not one and not affix:
        return []
    return [_number("two", two, one, affix), _number("both", one, affix, right), _number("shape", one, affix, shape(text[start:end][:MOST]))]


def mentions(text: str, seeds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what looks like an identifier and is over no seed."""
    groups: list[list] = []
    for m in _MENTION.finditer(text):
        numbers = bool(_NUMBERS.fullmatch(m[0].rstrip(_CLOSING.replace(")", ""))))
        if numbers and groups and groups[-1][2] and m.start() == groups[-1][1] + 1 and text[m.start() - 1] == " ":
            groups[-1][1] = m.end()
        else:
            groups.append([m.start(), m.end(), numbers])
    taken, k = sorted((s, e) for _, s, e in seeds), 0
    for start, end, numbers in groups:
        while end > start and text[end - 1] in _CLOSING:
            end -= 1
        if not numbers:
            start = max(start, max(text.rfind(c, start, end) for c in _GIVEN) + 1)
            while start < end and text[start] in _OPENING:
                start += 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if LEAST <= end - start <= MOST and not any(s < end for s, _ in taken[k : k + 1]) and any(c in "0123456789@" for c in text[start:end]):
            yield start, end


def scanned(docs: DataFrame) -> DataFrame:
    """``ROW`` for every document: its seeds, and all its mentions (k null where it is no seed) with instance and patterns."""
    # what the tasks need is bound here, so that it goes to the executors by value
    spans, looks, context, number = base_spans, mentions, patterns, _number
    span = [("k", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
    schema = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("found", pa.list_(pa.struct([*span, ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            base, found = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                seeds = spans(text)
                all_ = [*seeds, *((None, s, e) for s, e in looks(text, seeds))]
                base.append([{"k": k, "start": s, "stop": e} for k, s, e in seeds])
                found.append([{"k": k, "start": s, "stop": e, "instance": number(text[s:e].lower()), "patterns": p} for k, s, e in all_ if (p := context(text, s, e))])
            ids = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), *(pa.array(x, schema.field(i).type) for i, x in ((2, base), (3, found)))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, ROW)


def trusted_patterns(found: DataFrame, trust: float = TRUST, accept: float = ACCEPT, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((pattern, k, score) that are trusted, (instance, k, score) accepted) at the end of scoring, for mentions (k, instance, patterns)."""
    each = found.select("instance", "k", F.explode("patterns").alias("pattern"))
    edges = durable(each.groupBy("pattern", "instance").agg(F.min("k").alias("k")))  # repeated mentions count once
    seeds = durable(edges.groupBy("instance").agg(F.min("k").alias("k")).where("k IS NOT NULL").select("instance", "k", F.lit(1.0).alias("score")))
    known, n_known = seeds, -1
    trusted = None
    for _ in range(rounds):
        of = lambda i, value: F.sum(F.when(F.col("k") == i, value).otherwise(0))
        held = edges.drop("k").join(broadcast_if_small(known), "instance", "left").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), *[of(i, F.col("score")).alias(f"mass{i}") for i in range(len(KINDS))], *[of(i, F.lit(1)).alias(f"count{i}") for i in range(len(KINDS))]
        )
        best = F.array_max(F.array(*[F.struct((F.col(f"mass{i}") / (F.col("n") + 1)).alias("score"), F.lit(-i).alias("minus"), F.col(f"count{i}").alias("count")) for i in range(len(KINDS))]))
        before, trusted = trusted, durable(held.select("pattern", best.alias("b")).where((F.col("b.score") >= trust) & (F.col("b.count") >= support)).select("pattern", (-F.col("b.minus")).cast("int").alias("k"), "b.score"))
        reached = edges.select("pattern", "instance").join(broadcast_if_small(trusted), "pattern").join(broadcast_if_small(seeds.select("instance")), "instance", "left_anti")
        scores = reached.groupBy("instance").agg(F.max_by("k", F.struct(F.col("score"), -F.col("k"))).alias("k"), (1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
        grown = durable(seeds.unionByName(scores.where(F.col("score") >= accept)))
        if known is not seeds:
            discard(known)
        if before is not None:
            discard(before)
        known, n = grown, grown.count()
        if n == n_known:
            break
        n_known = n
    return trusted, known


def personal_data(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added for every row of ``docs``."""
    with scratch():
        rows = durable(scanned(docs))
        mentioned = rows.select("id", F.explode("found").alias("m")).select("id", "m.*")
        trusted, known = trusted_patterns(mentioned, **settings)
        loose = mentioned.where("k IS NULL").select("id", "start", "stop", "instance", F.explode("patterns").alias("pattern"))
        met = loose.join(broadcast_if_small(trusted), "pattern").join(broadcast_if_small(known.select("instance")), "instance", "left_semi")
        one = met.groupBy("id", "start", "stop").agg(F.max_by("k", F.struct(F.col("score"), -F.col("k"))).alias("k"))
        added = durable(one.groupBy("id").agg(F.collect_list(F.struct("k", "start", "stop")).alias("added")))
        both = durable(rows.drop("found").join(broadcast_if_small(added), "id", "left"))
        keep(both)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    counts = [F.size(F.filter(F.col("base.k"), lambda k: k == F.lit(KINDS.index(name)))).cast("bigint").alias(f"n_{name}") for name in KINDS]
    extra = F.coalesce("added", F.array().cast("array<struct<k:int,start:int,stop:int>>"))
    return both.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", extra))).alias("spans"), F.size(extra).cast("bigint").alias("n_added"))
