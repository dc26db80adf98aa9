"""Near-duplicate documents by min-max hashing.

Method: a document's set is its distinct word shingles. Under each of ``PERMUTATIONS``
permutations both the least and the greatest hash are kept, so a signature of ``2 *
PERMUTATIONS`` values costs half the hash evaluations. Bands of ``ROWS`` values
(one band draws on minima and maxima alike) hash to bucket keys: at similarity 0.8 all
40 bands miss with probability (1 - 0.8**5)**40, about 1e-7.

Documents with equal sets become one class first. In each bucket of several classes
every class is compared with one centre; then, where a bucket still spans several
components, with a centre drawn for that bucket. What still is apart is compared exactly:
small buckets pair by pair; the classes of larger ones by prefix filtering, which needs
no pair of a bucket to be formed. There the shingles of a class are put in one order, frequent
ones (by a bounded sample) last, and two sets can only be similar if they share one of the
first ``n - ceil(0.8 n) + 1``, so classes meet at those shingles alone, if their sizes allow
it: pair by pair where few meet. Classes that meet in a crowd (texts around one common
passage) are compared in their bucket, all outside its main component with those of a similar size, in
pairs of blocks of bounded size; there sketches of one byte for each value of the signature
go first, and sets are compared only if ``AGREE`` bytes agree (a similar pair has fewer with
a probability of about 1e-7). So no candidate pair of a bucket is left out unless both
already are in one component, and no group is gathered in one task. A comparison computes
the exact Jaccard similarity of the whole sets. Components grow by alternating large-star and
small-star steps on written tables.

Defined cases: null or wordless text has an empty set and is linked with nothing;
a text with fewer words than a shingle is one shingle. A class is named by a number, not
by a document's id: where rows repeat an id with other texts, each row is judged by its
own text. Rows without id keep a null component and are ``kept``. ``deduplicated`` keeps
of each component the least (id, hash of the text), and rows that repeat both only once.
Extra columns are ignored (kept by ``deduplicated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, packed

PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
NUM, DEN = 80, 100  # linked if DEN * intersection >= NUM * union
PAIRS = 16  # groups of up to so many classes are compared pair by pair
BLOCK = 256  # classes on one side of a block of a larger group
AGREE = 130  # so many of the 200 bytes of two sketches agree where sets are similar (160 are expected, 130 is over 5 standard deviations less)
HELD = 8 << 20  # bytes of sets on one side of a block of pairs
SAMPLE, FREQUENT = 2_000, 65_536  # sets that tell which shingles are frequent, and how many of these are told apart
SIZES = 1.26  # sets of similar size are in one step of this factor or in neighbouring ones (it must exceed DEN / NUM)
CHUNK = 4096  # shingles hashed at once

FITS = f"{DEN} * least(n, m) >= {NUM} * greatest(n, m)"  # sizes n and m that a link allows

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_A = (_RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.arange(2 * PERMUTATIONS).reshape(2, PERMUTATIONS).T.reshape(-1)  # minimum and maximum of a permutation side by side


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of products become evenly spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint64)
    raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not starts.size:
        return np.zeros(0, np.uint64)
    # a word's hash is the polynomial of its bytes, summed between its edges
    at = np.arange(raw.size)
    first = np.zeros(raw.size, np.int64)
    first[starts] = starts
    offset = at - np.maximum.accumulate(first)
    power = np.full(int(offset.max()) + 1, _M, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = np.where(space, np.uint64(0), _BYTE[raw] * power[offset])
    return _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _M)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    w = word_hashes(text)
    if w.size == 0:
        return w
    n = max(1, w.size - width + 1)
    out = np.full(n, np.uint64(min(width, w.size)))
    for k in range(min(width, w.size)):
        out = _mix(out * _M + w[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima, then the maxima, of the set under each permutation."""
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for at in range(0, x.size, CHUNK):
        h = _A * x[None, at : at + CHUNK] + _B
        low, high = np.minimum(low, h.min(1)), np.maximum(high, h.max(1))
    return np.concatenate((low, high))


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig[_ORDER].astype(np.uint64).reshape(ROWS, BANDS).T  # a band holds values of ROWS different permutations
    return _mix((_mix(rows + _BAND) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _M).view(np.int64)


def _signed(width: int):
    """(doc_id, th, text) -> the size, two digests and the band keys of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, d1, d2, keys = [], [], [], []
                for text in part.column(2):
                    s = shingle_set(text.as_py(), width)
                    n.append(s.size)
                    d1.append(int(_mix(s * _M).sum(dtype=np.uint64).view(np.int64)) if s.size else None)
                    d2.append(int(_mix(s ^ _M).sum(dtype=np.uint64).view(np.int64)) if s.size else None)
                    keys.append(bands(signature(s)) if s.size else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(keys)], ["doc_id", "th", "n", "d1", "d2", "bands"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [a.size for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _hashed(width: int):
    """(rep, n, comp, k, text) -> (rep, n, comp, k, h, sketch): the hashed set, and one byte of each value of its signature, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), width) for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], _lists([x.view(np.int64) for x in sets]), pa.array([signature(x).astype(np.uint8).tobytes() for x in sets], pa.binary())], ["rep", "n", "comp", "k", "h", "sketch"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have ``DEN * intersection >= NUM * union``."""
    if DEN * min(a.size, b.size) < NUM * max(a.size, b.size) or not a.size:
        return False
    at = np.minimum(np.searchsorted(b, a), b.size - 1)
    both = int((b[at] == a).sum())
    return DEN * both >= NUM * (a.size + b.size - both)


def _compared(width: int):
    """(a, b, text_a, text_b) -> the pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if last[0] != a[i]:
                    last = (a[i], shingle_set(batch.column(2)[i].as_py(), width))
                keep[i] = similar(last[1], shingle_set(batch.column(3)[i].as_py(), width))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``texts``: (rep, text)."""
    left = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compared(width), "a bigint, b bigint")


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, a, b, h), sorted by key and kind: first the sets h of the classes a, then pairs -> the similar pairs."""
    key, sets = None, {}
    for batch in batches:
        found = []
        for i, (k, kind, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
            if k != key:
                key, sets = k, {}
            if kind == 0:
                sets[a] = batch.column(4)[i].values.to_numpy(zero_copy_only=False).view(np.uint64).copy()
            elif similar(sets[a], sets[b]):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


class _Forest:
    """Union-find over the few members of two blocks."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, rep, n, comp, h, sketch), sorted by key -> links between members of different components of both sides."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        n, forest, links = np.array([r[2] for r in rows]), _Forest([r[3] for r in rows]), []
        sketches = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), 2 * PERMUTATIONS)
        side = np.array([r[0] for r in rows])
        two = np.flatnonzero(side == 2)
        for i in np.flatnonzero(side == 1):
            fit = two[DEN * np.minimum(n[i], n[two]) >= NUM * np.maximum(n[i], n[two])]
            for j in fit[(sketches[fit] == sketches[i]).sum(1) >= AGREE]:
                if rows[i][1] != rows[j][1] and forest.root(i) != forest.root(j) and similar(rows[i][4], rows[j][4]):
                    forest.join(i, j)
                    links.append((rows[i][1], rows[j][1]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        sets = (x.values.to_numpy(zero_copy_only=False).view(np.uint64).copy() for x in batch.column(5))
        for k, s, rep, n, comp, own, sketch in zip(*(c.to_pylist() for c in batch.columns[:5]), sets, batch.column(6).to_pylist(), strict=True):
            if k != key and rows:
                yield solve(rows)
                rows = []
            key = k
            rows.append((s, rep, n, comp, own, sketch))
    if rows:
        yield solve(rows)


def _open_nodes(edges: DataFrame) -> int:
    """How many nodes of the edges (u, v), u > v, keep them from being stars around the least node."""
    ends = edges.selectExpr("u AS node", "v", "false AS centre").unionByName(edges.selectExpr("v AS node", "CAST(NULL AS bigint) AS v", "true AS centre"))
    ends = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.bool_or("centre").alias("centre"))
    return ends.where("least <> most OR centre AND least IS NOT NULL").count()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the least node that can be reached.

    Large-star and small-star steps alternate until every component is a star; each round is a written table.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _open_nodes(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = durable(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _grouped(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n, least for every row; least is the least (doc_id, th) of the row's component, null where it takes no part."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = durable(texts.mapInArrow(_signed(width), "doc_id bigint, th bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"))
    whole = signed.where("n > 0 and doc_id is not null")
    classes = whole.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("own"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()))
    posted = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    full = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.min(F.struct(F.xxhash64("rep", "bucket"), "rep"))["rep"].alias("drawn")).where("size > 1")
    posted = durable(posted.join(full, "bucket"))
    involved = durable(classes.select("rep", "own.doc_id", "own.th").join(posted.select("rep").distinct(), "rep", "left_semi"))
    held = durable(texts.join(broadcast_if_small(involved), ["doc_id", "th"]).dropDuplicates(["rep"]).select("rep", "text"))

    def star(posts: DataFrame, centre: str) -> DataFrame:
        size = posts.where(F.col("rep") == F.col(centre)).select("bucket", F.col("n").alias("m"), F.col("comp").alias("c"))
        near = posts.where(F.col("rep") != F.col(centre)).join(size, "bucket").where(FITS).where("comp <> c")
        return near.select(F.least("rep", centre).alias("a"), F.greatest("rep", centre).alias("b")).distinct()

    posts, comp = posted.withColumn("comp", F.col("rep")), None
    for centre in ("low", "drawn", None):
        found = durable(_linked(star(posts, centre), held, width) if centre else _rest(posts, held, width))
        if found.take(1):
            comp = components(found if comp is None else found.unionByName(comp.toDF("a", "b")))
        if centre and comp is not None:
            # what is left: buckets that still span several components
            posts = posts.drop("comp").join(comp.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            apart = posts.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
            posts = durable(posts.join(apart, "bucket"))
            if not posts.take(1):
                break
    named = classes.select("rep", "d1", "d2", F.col("own").alias("least"))
    if comp is not None:
        linked = comp.toDF("rep", "comp")
        lowest = linked.join(named, "rep").groupBy("comp").agg(F.min("least").alias("lowest"))
        named = named.join(linked.join(lowest, "comp").select("rep", "lowest"), "rep", "left").select("d1", "d2", F.coalesce("lowest", "least").alias("least"))
    return signed.select("doc_id", "th", "n", "d1", "d2").join(named.select("d1", "d2", "least"), ["d1", "d2"], "left").select("doc_id", "th", "n", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    out = _grouped(docs, width).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(posts: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """Links between different components of one bucket, by comparing all that the stars left open."""
    sizes = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members"))
    once = sizes.groupBy("k", "members").agg(F.min("bucket").alias("bucket"))  # buckets with the same members are one
    posts = durable(posts.join(once.select("bucket", "k"), "bucket").select(F.col("bucket").alias("g"), "k", "rep", "n", "comp"))
    open_ = posts.groupBy("rep", "n", "comp").agg(F.max("k").alias("k")).join(held, "rep")
    sets = durable(open_.select("rep", "n", "comp", "k", "text").mapInArrow(_hashed(width), "rep bigint, n bigint, comp bigint, k bigint, h array<bigint>, sketch binary"))
    met = durable(_prefixes(sets.where(F.col("k") > PAIRS)))
    pairs = _small_pairs(posts.where(F.col("k") <= PAIRS)).unionByName(_small_pairs(met.where(F.col("k") <= PAIRS)))
    crowded = met.where(F.col("k") > PAIRS).select("rep").distinct()
    return _verified(durable(pairs.distinct()), sets).unionByName(_blocks(posts.where(F.col("k") > PAIRS).join(crowded, "rep"), sets))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Both ends are dealt to blocks of HELD bytes of sets, so a set goes once to each pair of blocks that needs it and not once to each pair."""
    parts = max(1, -(-8 * (sets.agg(F.sum("n")).first()[0] or 0) // HELD))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    keyed = pairs.select((block("a") * parts + block("b")).alias("key"), "a", "b")
    needed = keyed.select("key", F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = needed.join(sets.select("rep", "h"), "rep").select("key", F.lit(0).alias("kind"), F.col("rep").alias("a"), F.lit(0).cast("bigint").alias("b"), "h")
    both = own.unionByName(keyed.select("key", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("array<bigint>").alias("h")))
    return both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_similar_pairs, "a bigint, b bigint")


def _small_pairs(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of each small group ``g`` whose sizes fit and whose components differ."""
    other = members.select("g", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("comp").alias("c"))
    return members.withColumnRenamed("rep", "a").join(other, "g").where("a < b and comp <> c").where(FITS).select("a", "b").distinct()


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT shingles that most sets of a sample have, ordered, and how many sets have each."""
    every = max(1, sets.count() // SAMPLE)
    uses = sets.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    rows = uses.where("c > 1").orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    h, c = np.array([r["h"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _leading(frequent: np.ndarray, counts: np.ndarray):
    """(rep, n, comp, h) -> (g, rep, n, comp) for each shingle g that leads the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = []
            for x in batch.column(3):
                h = x.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(frequent, h), max(0, frequent.size - 1))
                c = np.where(frequent[at] == h, counts[at], 0) if frequent.size else np.zeros(h.size, np.int64)
                leads.append(h[np.lexsort((h, c))[: h.size - (NUM * h.size + DEN - 1) // DEN + 1]])
            owner = np.repeat(np.arange(batch.num_rows), [x.size for x in leads])
            rest = [c.take(pa.array(owner)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *leads])), *rest], ["g", "rep", "n", "comp"])

    return run


def _prefixes(sets: DataFrame) -> DataFrame:
    """g (a shingle), k (how many classes meet there), rep, n, comp: the shingles that lead a set, rare ones first, where others meet it.

    Any one order of the shingles serves; the sample that tells the frequent ones decides how few classes meet, not which links are found.
    """
    posts = durable(sets.select("rep", "n", "comp", "h").mapInArrow(_leading(*_frequent(sets)), "g bigint, rep bigint, n bigint, comp bigint"))
    many = posts.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("g", "k")
    return posts.join(many, "g")


def _blocks(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of large groups: all outside a group's main component meet everyone of a similar size, in blocks of both sides."""
    main = large.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    sized = durable(large.join(main, "g").select("g", "rep", "comp", "main", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZES))).cast("int").alias("step")))
    left = sized.where("comp <> main").select("g", "step", "rep")
    right = sized.select("g", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), "rep")
    many = left.groupBy("g", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows")).join(right.groupBy("g", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cols")), ["g", "step"])
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(many, ["g", "step"]).select("g", "step", block("rows").alias("i"), over("cols").alias("j"), F.lit(1).alias("side"), "rep")
    two = right.join(many, ["g", "step"]).select("g", "step", over("rows").alias("i"), block("cols").alias("j"), F.lit(2).alias("side"), "rep")
    spread = one.unionByName(two).select(F.concat_ws("/", "g", "step", "i", "j").alias("key"), "side", "rep")
    spread = spread.join(sets.select("rep", "n", "comp", "h", "sketch"), "rep").select("key", "side", "rep", "n", "comp", "h", "sketch").repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(_block_links, "a bigint, b bigint")


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each component, the one of least id (then hash of its text); rows without id stay."""
    rows = durable(_grouped(docs, width).where("doc_id is not null").select("doc_id", "th", "least"))
    gone = durable(rows.where("doc_id <> least.doc_id or th <> least.th").select("doc_id", "th").distinct())
    twice = durable(rows.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"))
    marked = packed(docs).select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("th"))
    kept = marked.join(broadcast_if_small(gone), ["doc_id", "th"], "left_anti")
    if not twice.take(1):
        return kept.select("row.*")
    repeated = broadcast_if_small(twice)
    one = kept.join(repeated, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return kept.join(repeated, ["doc_id", "th"], "left_anti").unionByName(one).select("row.*")
