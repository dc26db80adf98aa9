"""Removal of byte strings that occur earlier in the corpus, by longest-previous-factor arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document of smaller id, or earlier in the same document). In terms of the
longest-previous-factor array: position ``p`` starts such a string if ``LPF[p] >= LENGTH``.

Method: the suffix array of the corpus is built in buckets. The bucket of a suffix is
the least hash among the ``K``-byte strings of its first ``LENGTH`` bytes (equal strings
share it); neighbouring suffixes that share one occurrence of it form a run. Buckets
with a single run hold no repeat and are dropped after a count. Within a bucket, runs with
equal bytes collapse onto the first one (the rest repeats it whole), and what is left is
suffix-sorted by prefix doubling to depth ``LENGTH``. In suffix order the previous and the
next suffix that start earlier in the text are found as nearest smaller values, and the
longer of the two common prefixes is ``LPF`` (up to ``LENGTH``, among the suffixes of the
bucket: as equal strings share a bucket, ``LPF >= LENGTH`` is that of the corpus). A bucket of more than
``BUCKET`` different runs (a passage whose surroundings differ in very many documents)
takes another exact way: its suffixes are grouped by a 128-bit hash of their ``LENGTH``
bytes, with the first position as a combinable minimum, so no task gathers the bucket.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; matches never
cross documents; rows that repeat an id and its text are the same document; where rows
repeat an id with other texts, the text of least hash stands for it and the others take
no part and lose nothing; rows without id take no part and lose nothing. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, durable

LENGTH, K = 100, 24
SPAN = LENGTH - K + 1  # strings of K bytes in one of LENGTH
BUCKET = 16_384  # pieces of at most 176 bytes, 2.9 MB
BUFFER = 1 << 19  # bytes worked on at once; positions in a buffer must fit POS_BITS
POS_BITS = np.uint64(20)
IDS = 500_000  # ids that may be broadcast (8 bytes each)

_RNG = np.random.default_rng(7)
_T1, _T2 = (_RNG.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(raw: np.ndarray, table: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the K bytes and of the LENGTH bytes from each position, by doubling; at least LENGTH bytes."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(int(base), n, 1 << 64))

    by = {1: table[raw]}
    for n in (1, 2, 4, 8, 16, 32):
        by[2 * n] = by[n][:-n] * power(n) + by[n][n:]
    k = by[16][: raw.size - K + 1] * power(8) + by[8][16 : raw.size - 8 + 1]
    w = raw.size - LENGTH + 1
    full = (by[64][:w] * power(32) + by[32][64 : 64 + w]) * power(4) + by[4][96 : 96 + w]
    return _mix(k), _mix(full)


def _segments(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces (doc_id, offset, bytes) of the texts that share only LENGTH - 1 bytes, some BUFFER bytes at a time."""
    held, size = [], 0
    texts = batch.column(1)
    for i, doc in enumerate(batch.column(0).to_pylist()):
        raw = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - LENGTH + 1, BUFFER):
            piece = raw[at : at + BUFFER + LENGTH - 1]
            if held and size + len(piece) > BUFFER + LENGTH:
                yield held
                held, size = [], 0
            held.append((doc, at, piece))
            size += len(piece)
    if held:
        yield held


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, the window starts that cross no border, and the piece of each start."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    counts = sizes - LENGTH + 1
    first = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[piece]
    return raw, starts, piece


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (key, digest, doc_id, start, n): runs of n window starts that share an anchor."""
    for batch in batches:
        for held in _segments(batch):
            raw, starts, piece = _joined([p for _, _, p in held])
            k, full = window_hashes(raw, _T1, _M1)
            low = (k >> POS_BITS << POS_BITS) | np.arange(k.size, dtype=np.uint64)
            n = 1
            while 2 * n <= SPAN:
                low = np.minimum(low[:-n], low[n:])
                n *= 2
            low = np.minimum(low[: k.size - SPAN + 1], low[SPAN - n : SPAN - n + k.size - SPAN + 1])
            anchor = (low[starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))))
            size = np.diff(np.concatenate((new, [starts.size])))
            step = np.arange(starts.size) - np.repeat(new, size)
            digest = np.add.reduceat(_mix(full[starts] + step.astype(np.uint64) * _M2), new) + size.astype(np.uint64) * _M1
            doc, offset = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            begun = starts[new] - (np.cumsum([len(h[2]) for h in held]) - np.array([len(h[2]) for h in held]))[piece[new]] + offset[piece[new]]
            yield pa.RecordBatch.from_arrays([pa.array(k[anchor[new]].view(np.int64)), pa.array(_mix(digest).view(np.int64)), pa.array(doc[piece[new]]), pa.array(begun), pa.array(size.astype(np.int32))], ["key", "digest", "doc_id", "start", "n"])


def previous_smaller(q: np.ndarray) -> np.ndarray:
    """For each place of ``q`` the nearest one before it with a smaller value, -1 where there is none, by minima of power-of-two blocks."""
    blocks = [q.astype(np.int32)]
    while 2 << (len(blocks) - 1) <= q.size:
        half = 1 << (len(blocks) - 1)
        blocks.append(np.minimum(blocks[-1][:-half], blocks[-1][half:]))
    end = np.arange(q.size)  # all from here to the place itself are larger
    for k in reversed(range(len(blocks))):
        begin = end - (1 << k)
        larger = (begin >= 0) & (blocks[k][np.maximum(begin, 0)] > blocks[0])
        end = np.where(larger, begin, end)
    return end - 1


def lpf(raw: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array of the starts, up to LENGTH: how many bytes from each also begin at an earlier start of its group.

    ``starts`` are in text order within each group and have LENGTH bytes each.
    """
    code = np.zeros(raw.size, np.uint64)
    ahead = np.concatenate((raw, np.zeros(7, np.uint8)))
    for j in range(8):
        code = (code << np.uint64(8)) | ahead[j : j + raw.size]
    depth, rank = 8, np.unique(code[: raw.size - 7], return_inverse=True)[1].astype(np.int64)
    by = {8: rank}
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        pair = rank[: rank.size - step] * (rank.size + 1) + rank[step:]
        if depth + step == LENGTH:
            pair = pair[starts]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth += step
        by[depth] = rank

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.zeros(a.size, np.int64)
        for d in (64, 32, 16, 8):
            at = np.where(n + d <= LENGTH, n, 0)
            n += np.where(n + d <= LENGTH, d, 0) * (by[d][a + at] == by[d][b + at])
        x = code[a + n] ^ code[b + n]
        return np.minimum(LENGTH, n + sum((x >> np.uint64(64 - 8 * j) == 0).astype(np.int64) for j in range(1, 9)))

    order = np.lexsort((np.arange(starts.size), rank, group))  # suffix order within each group, equal strings in text order
    new = np.concatenate(([True], (rank[order[1:]] != rank[order[:-1]]) | (group[order[1:]] != group[order[:-1]])))[: starts.size]
    found = np.full(starts.size, LENGTH, np.int64)  # all but the first of equal strings
    first = order[new]
    found[first] = 0
    for near in (previous_smaller(first), first.size - 1 - previous_smaller(first[::-1])[::-1]):
        mine = np.flatnonzero((near >= 0) & (near < first.size))
        mine = mine[group[first[mine]] == group[first[near[mine]]]]
        found[first[mine]] = np.maximum(found[first[mine]], common(starts[first[mine]], starts[first[near[mine]]]))
    return found


def _spans(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Marked windows (doc, start), in order, as byte spans; neighbours become one span."""
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))) if at.size else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [at.size]))[: new.size] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[new], pa.int64()), pa.array(at[new], pa.int64()), pa.array(at[last] + LENGTH, pa.int64())], ["doc_id", "a", "b"])


def _bucket_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, start, piece) sorted by key and text order -> spans with an earlier match in their bucket."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        raw, starts, piece = _joined([r[3] for r in rows])
        keys, docs, begun = (np.array([r[c] for r in rows]) for c in (0, 1, 2))
        sizes = np.array([len(r[3]) for r in rows])
        hit = lpf(raw, starts, keys[piece]) >= LENGTH
        at = starts - (np.cumsum(sizes) - sizes)[piece] + begun[piece]
        return _spans(docs[piece][hit], at[hit])

    rows, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and size >= BUFFER:
                yield solve(rows)
                rows, size = [], 0
            key = row[0]
            rows.append(row)
            size += len(row[3])
    if rows:
        yield solve(rows)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, start, piece) -> (h1, h2, doc_id, at) of every window."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for i in range(0, len(rows), 2000):
            part = rows[i : i + 2000]
            raw, starts, piece = _joined([r[3] for r in part])
            sizes = np.array([len(r[3]) for r in part])
            at = starts - (np.cumsum(sizes) - sizes)[piece] + np.array([r[2] for r in part])[piece]
            h = [window_hashes(raw, t, m)[1][starts].view(np.int64) for t, m in ((_T1, _M1), (_T2, _M2))]
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.array([r[1] for r in part])[piece]), pa.array(at)], ["h1", "h2", "doc_id", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs of starts) -> (key, doc_id, start, piece of the text's bytes)."""
    for batch in batches:
        for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["key"] for r in runs], pa.int64()), pa.array([doc] * len(runs), pa.int64()), pa.array([r["start"] for r in runs], pa.int64()), pa.array([raw[r["start"] : r["start"] + r["n"] + LENGTH - 1] for r in runs], pa.binary()), pa.array([r["k"] for r in runs], pa.int64())],
                ["key", "doc_id", "start", "piece", "k"],
            )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> the digest columns."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, end, removed, runs = hashlib.sha256(), 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or []):
                if a > end or not runs:
                    runs += 1
                    kept.update(raw[end:a])
                removed += max(0, b - max(a, end))
                end = max(end, b)
            kept.update(raw[end:])
            out.append((doc, len(raw), removed, runs, kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RUN = "key bigint, digest bigint, doc_id bigint, start bigint, n int"
SPAN_ROW = "doc_id bigint, a bigint, b bigint"


def _odd(docs: DataFrame) -> DataFrame | None:
    """doc_id, th: the text's hash that stands for each id that rows repeat with other texts; None where no id is."""
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    odd = durable(hashed.groupBy("doc_id").agg(F.min("th").alias("th"), F.max("th").alias("most")).where("th <> most").select("doc_id", "th"))
    return odd if odd.take(1) else None


def _own(texts: DataFrame, odd: DataFrame | None) -> DataFrame:
    """``texts`` with ``own``: whether the row's text stands for its id."""
    if odd is None:
        return texts.withColumn("own", F.lit(True))
    return texts.join(broadcast_if_small(odd), "doc_id", "left").withColumn("own", F.coalesce(F.col("th") == F.xxhash64("text"), F.lit(True))).drop("th")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a, b: byte spans that a string of LENGTH bytes which occurs earlier covers (spans may overlap)."""
    return _repeated_spans(docs, _odd(docs))


def _repeated_spans(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= LENGTH)
    texts = _own(texts, odd).where("own").drop("own")
    runs = texts.mapInArrow(_runs, RUN)
    shared = durable(runs.groupBy("key").count().where("count > 1").select("key"))
    runs = durable(runs.join(shared, "key", "left_semi"))
    discard(shared)
    firsts = runs.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c"))
    firsts = durable(firsts.select("key", "digest", F.col("f.doc_id").alias("d0"), F.col("f.start").alias("s0"), "n", "c"))
    copies = runs.join(firsts.where("c > 1").select("key", "digest", "d0", "s0"), ["key", "digest"]).where("doc_id <> d0 or start <> s0")
    copied = durable(copies.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b")))
    discard(runs)

    mixed = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    open_ = durable(firsts.join(mixed, "key").select("key", "k", F.col("d0").alias("doc_id"), F.col("s0").alias("start"), "n"))
    discard(firsts)
    by_doc = open_.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", "k")).alias("runs"))  # at most the document's own runs
    ids = durable(open_.select("doc_id").distinct())
    own = texts.join(broadcast_if_small(ids, IDS), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    pieces = durable(own.join(by_doc, "doc_id").mapInArrow(_cut, "key bigint, doc_id bigint, start bigint, piece binary, k bigint"))
    discard(open_, ids)
    sorted_ = pieces.where(F.col("k") <= BUCKET).drop("k").repartition("key").sortWithinPartitions("key", "doc_id", "start")
    windows = durable(pieces.where(F.col("k") > BUCKET).drop("k").mapInArrow(_hashed, "h1 bigint, h2 bigint, doc_id bigint, at bigint"))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2", F.col("f.doc_id").alias("d0"), F.col("f.at").alias("s0"))
    later = windows.join(first, ["h1", "h2"]).where("doc_id <> d0 or at <> s0")
    spans = copied.unionByName(sorted_.mapInArrow(_bucket_spans, SPAN_ROW))
    spans = durable(spans.unionByName(later.select("doc_id", F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b"))))
    discard(copied, pieces, windows)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    odd = _odd(docs)
    spans = _repeated_spans(docs, odd).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = _own(texts, odd).join(spans, "doc_id", "left").select("doc_id", "text", F.when(F.col("own"), F.col("spans")).alias("spans"))
    return joined.mapInArrow(_removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
