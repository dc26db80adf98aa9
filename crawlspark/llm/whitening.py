"""Whitening of embeddings with compensated covariances.

Method: entries become integers; a first pass sums them, a second one sums the outer
products of the centred vectors. All sums are kept in double-double: a product is split
into its rounded value and its error (Dekker's product), a sum likewise (Knuth's sum), and
tasks hand over high and low parts, which are merged the same way. The covariance is made
tridiagonal by reflections and solved by divide and conquer: halves are solved alone,
joined by a rank-one change whose eigenvalues are the roots of the secular equation, and
the vectors come from a recomputed rank-one vector (so they stay orthogonal).

Only sums come to the driver: two numbers for each pair of dimensions, whatever the number
of rows and tasks; tasks' sums meet in groups (``SPREAD`` at first, then one) a chunk of
``CHUNK`` entries each. The driver and a task hold a few matrices of dimension x dimension.

Defined cases: rows whose vector is null or holds a null or an entry that is not finite go,
so do vectors of another length than the most frequent one (ties: the longest), for which
no covariance is defined; empty vectors give no component; entries beyond 2^46 in size
count as 2^46; a component without variance (up to rounding) has null ``whitened``, and
``explained`` is null where nothing varies at all; rows that repeat an id all count and all
return; an empty table gives no rows; extra columns are ignored. A ``deviation`` beyond the
range of a long raises OverflowError: no result of the asked type exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

COMPONENTS = 32
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**46
CHUNK, SPREAD = 4096, 64  # entries of a sum that are merged together; groups of tasks that merge first
BLOCK = 1 << 18  # numbers of a block of products
PARTIAL = "chunk int, part bigint, high array<double>, low array<double>"
EPS = np.finfo(float).eps


# --- sums without loss


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b rounded, and its error."""

    def halves(x):
        t = 134217729.0 * x
        high = t - (t - x)
        return high, x - high

    p, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def fold(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum over the first axis, by halves."""
    while len(high) > 1:
        n = len(high) // 2
        s = add((high[:n], low[:n]), (high[n : 2 * n], low[n : 2 * n]))
        high, low = (np.concatenate((x, y[2 * n :])) for x, y in zip(s, (high, low), strict=True))
    return high[0], low[0]


def compensated_sum(rows: DataFrame, terms: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of all the (row, ``width``) high and low terms that ``terms`` makes of the batches of ``rows``."""
    chunk, spread, partial = CHUNK, SPREAD, pa.schema([("chunk", pa.int32()), ("part", pa.int64()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(width), np.zeros(width))
        for batch in batches:
            for high, low in terms(batch):
                if len(high):
                    total = add(total, fold(high, low))
        starts = range(0, width, chunk)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([part] * len(starts), pa.int64()), *(pa.array([x[i : i + chunk] for i in starts], pa.list_(pa.float64())) for x in total)], schema=partial)

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # so that reruns agree
        high, low = fold(*(np.array(table.column(c).to_pylist(), dtype=float) for c in ("high", "low")))
        return pa.table([table.column("chunk").slice(0, 1), table.column("part").slice(0, 1), pa.array([high]), pa.array([low])], schema=partial)

    parts = rows.mapInArrow(summed, PARTIAL)
    some = parts.groupBy("chunk", F.pmod("part", F.lit(spread))).applyInArrow(lambda t: merged(t), PARTIAL)
    whole = some.groupBy("chunk").applyInArrow(lambda t: merged(t), PARTIAL).orderBy("chunk").collect()
    if not whole:
        return np.zeros(width), np.zeros(width)
    return tuple(np.concatenate([r[c] for r in whole]) for c in ("high", "low"))


def upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def outer_products(high: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Double-double products of all pairs of dimensions, in blocks of rows; the upper triangle of each row's outer product."""
    i, j = upper(high.shape[1])
    step = max(1, BLOCK // max(1, i.size))
    for at in range(0, len(high), step):
        a, b = high[at : at + step], low[at : at + step]
        p, e = two_product(a[:, i], a[:, j])
        yield p, e + (a[:, i] * b[:, j] + b[:, i] * a[:, j])


def square(sums: tuple[np.ndarray, np.ndarray], d: int, n: int) -> np.ndarray:
    """The matrix of an upper triangle of sums, divided by ``n``."""
    q = sums[0] / n
    p, e = two_product(q, np.full_like(q, float(n)))
    v, (i, j) = np.zeros((d, d)), upper(d)
    v[i, j] = v[j, i] = q + ((sums[0] - p) - e + sums[1]) / n
    return v


# --- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if size == 0 or not x[1:].any():
            continue
        x /= size
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        x /= np.sqrt(x @ x)
        part = a[k + 1 :, k:]
        part -= 2 * np.outer(x, x @ part)
        part = a[k:, k + 1 :]
        part -= 2 * np.outer(part @ x, x)
        part = q[:, k + 1 :]
        part -= 2 * np.outer(part @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of a symmetric tridiagonal matrix."""
    n = len(d)
    if n <= 1:
        return d.copy(), np.eye(n)
    m = n // 2
    rho, left, right = e[m - 1], d[:m].copy(), d[m:].copy()
    left[-1] -= rho
    right[0] -= rho
    (w1, q1), (w2, q2) = divide(left, e[: m - 1]), divide(right, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    sign = -1.0 if rho < 0 else 1.0
    w, v = rank_one(sign * np.concatenate((w1, w2)), abs(rho), np.concatenate((q1[-1], q2[0])))
    w, v = sign * w, q @ v
    order = np.argsort(w, kind="stable")
    return w[order], v[:, order]


def rank_one(d: np.ndarray, rho: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z' with rho >= 0."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z, q = d[order].copy(), z[order].copy(), np.eye(n)[:, order]
    least = 8 * EPS * max(np.abs(d).max(), rho * (z @ z))
    live: list[int] = []  # the others keep their value and vector
    for i in range(n):
        if rho * abs(z[i]) * np.sqrt(z @ z) <= least:
            z[i] = 0.0
            continue
        if live and (d[i] - d[live[-1]]) * abs(z[i] * z[live[-1]]) / (z[i] ** 2 + z[live[-1]] ** 2) <= least:
            p = live.pop()  # equal values: turn the pair so that one leaves the change
            r = np.hypot(z[p], z[i])
            c, s = z[i] / r, z[p] / r
            q[:, p], q[:, i] = c * q[:, p] - s * q[:, i], s * q[:, p] + c * q[:, i]
            d[p], d[i] = c * c * d[p] + s * s * d[i], s * s * d[p] + c * c * d[i]
            z[p], z[i] = 0.0, r
        live.append(i)
    if not live:
        return d, q
    k = np.array(live)
    shift, tau = secular(d[k], rho, z[k])
    gap = (d[k][shift][None, :] - d[k][:, None]) + tau[None, :]  # root j less pole i
    between = d[k][None, :] - d[k][:, None]
    np.fill_diagonal(between, 1.0)
    ratio = gap / between
    np.fill_diagonal(ratio, np.diag(gap) / rho)
    zed = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), z[k])
    v = zed[:, None] / -gap
    v /= np.sqrt((v * v).sum(0))
    w, vectors = d.copy(), q.copy()
    w[k], vectors[:, k] = d[k][shift] + tau, q[:, k] @ v
    return w, vectors


def secular(d: np.ndarray, rho: float, z: np.ndarray, steps: int = 1100) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pole, distance from it) of each root of 1 + rho sum z^2 / (d - x), by halving; d rises strictly."""
    k = len(d)
    ends = np.append(d[1:], d[-1] + rho * (z @ z))
    half = (ends - d) / 2

    def value(pole: np.ndarray, tau: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return 1 + rho * ((z * z)[None, :] / ((d[None, :] - d[pole][:, None]) - tau[:, None])).sum(1)

    at = np.arange(k)
    lower = (value(at, half) >= 0) | (at == k - 1)  # the root is in the half next to its own pole
    pole = np.where(lower, at, np.minimum(at + 1, k - 1))
    low, high = np.where(lower, 0.0, -half), np.where(lower, np.where(at == k - 1, 2 * half, half), 0.0)
    for _ in range(steps):
        tau = (low + high) / 2
        if ((tau == low) | (tau == high)).all():
            break
        up = value(pole, tau) >= 0
        low, high = np.where(up, low, tau), np.where(up, tau, high)
    return pole, np.where(lower, high, low)  # never the pole itself


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix (falling, at least 0) and their unit vectors as columns."""
    size = np.abs(v).max() if v.size else 0.0
    d, e, q = tridiagonal(v / size if size else v)
    w, u = divide(d, e)
    return np.maximum(w[::-1], 0) * (size or 1.0), (q @ u)[:, ::-1]


# --- the operator


def _entries(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """x of every entry of a batch of vectors, as doubles that are whole numbers."""
    flat = batch.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).reshape(-1, d) + SHIFT


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that are whitened, and their length."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", odd))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    return rows.where(F.size("v") == d), d


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; one row for each usable vector and component."""
    rows, d = usable(vectors, column)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    k = min(components, d)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    values = rows.select("v")
    with_count = compensated_sum(values, lambda b: iter([(x := np.column_stack((_entries(b, 0, d), np.ones(b.num_rows))), np.zeros_like(x))]), d + 1)
    sums = [int(h) + int(low) for h, low in zip(*with_count, strict=True)]  # exact: whole numbers in high and low part
    n = sums.pop()
    base = [s // n for s in sums]
    rest = [Fraction(s - n * b, n) for s, b in zip(sums, base, strict=True)]  # the mean is base + rest
    origin, rest_high = np.array(base, dtype=float), np.array([float(r) for r in rest])
    rest_low = np.array([float(r - Fraction(h)) for r, h in zip(rest, rest_high, strict=True)])

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = two_sum(x - origin, -rest_high)
        return high, low - rest_low

    v = square(compensated_sum(values, lambda b: outer_products(*centred(_entries(b, 0, d))), d * (d + 1) // 2), d, n)
    e, u = eigen(v)
    trace = float(np.trace(v))
    varies = e[:k] > trace * d * EPS
    weights = np.where(varies, u[:, :k] / np.sqrt(np.where(varies, e[:k], 1.0)), 0.0)
    over = [s - n * b for s, b in zip(sums, base, strict=True)]

    def deviations(x: np.ndarray) -> list[int]:
        y = x - origin
        if (n * (np.abs(y).max(initial=0) + 1)) ** 2 * d < 2**63:
            return (((n * y.astype(np.int64) - np.array(over)) ** 2).sum(1)).tolist()
        found = [sum((n * int(a) - o) ** 2 for a, o in zip(r, over, strict=True)) for r in y]
        if max(found) >= 2**63:
            raise OverflowError(f"deviation {max(found)} is no long")
        return found

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _entries(batch, 1, d)
            high, low = centred(x)
            w = (high + low) @ weights
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x), pa.int64()), lists], ["vec_id", "deviation", "w"])

    done = durable(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v").mapInArrow(projected, "vec_id bigint, deviation bigint, w array<double>"))
    error = _identity_error(done.select("w"), k, n, varies)
    share = e[:k] / trace if trace > 0 else None
    each = F.posexplode("w").alias("i", "whitened")
    at = lambda xs: F.array(*[F.lit(None if x is None else x).cast("double") for x in xs])[F.col("i")]
    shown = F.when(F.array(*[F.lit(bool(x)) for x in varies])[F.col("i")], F.col("whitened"))
    return done.select("vec_id", "deviation", each).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", shown.alias("whitened"), at([float(x) for x in share] if share is not None else [None] * k).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def _identity_error(done: DataFrame, k: int, n: int, varies: np.ndarray) -> float | None:
    """The largest absolute entry of the covariance of what was whitened, less the identity; None where nothing varies."""
    if not varies.any():
        return None

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    high, low = compensated_sum(done, lambda b: iter([(w := read(b), np.zeros_like(w))]), k)
    mean = (high + low) / n
    cov = square(compensated_sum(done, lambda b: outer_products(*two_sum(read(b), -mean)), k * (k + 1) // 2), k, n)
    return float(np.abs(cov - np.eye(k))[np.ix_(varies, varies)].max())
