"""Language identification by a bidirectional gated recurrent network over bytes.

Method: one recurrent layer reads the bytes of a text forwards, one backwards; their
joined states label every byte position with language probabilities, and a document's
probabilities are the mean over all its positions. The network is trained in numpy by
backpropagation through time with Adam. One more label, ``und``, is trained on letters of
no learned language (``foreign``), and takes its share of a document's probability: ``accepted`` rejects a document whose
languages together have less than the network's ``least``. That threshold is the ``MISSED`` quantile of the sampled
documents that are labelled rightly, ``MOST`` at most. ``identify`` rejects nothing: a text with a letter
gets the learned language that is most probable, with its probability as score.

Training sample (the documented bound): about ``PER_LANGUAGE`` documents of each language,
drawn by a hash of their id (rows that repeat an id count once), and ``WINDOWS`` windows spread over the whole of each, whatever
the size of the corpus; more than ``MAX_LANGUAGES`` values of lang are refused. Prediction
reads every byte of every text, in pieces of at most ``PIECE`` bytes that are run side by
side: states start anew in each piece (which may begin inside a character), so a position
sees at most its piece, as in training it sees at most a window of ``WINDOW`` bytes.
Letters are lower-cased beforehand.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no
labelled text at all everything is ``und`` (and ``accepted``, which then has nothing to
judge by, keeps all texts with a letter); a null language and ``und`` teach nothing. Rows keep
their multiplicity; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash01, packed

HIDDEN = 8
PER_LANGUAGE, WINDOWS, WINDOW = 300, 4, 64
MAX_LANGUAGES = 256
STEPS, BATCH, RATE = 120, 256, 0.03
PIECE, SIDE_BY_SIDE = 128, 1024  # bytes of a piece, pieces run at once
UNKNOWN = "und"
MISSED, MOST = 0.001, 0.1
# First and last letter of scripts that foreign text is made of, as far as the sample does not use them
SCRIPTS = ((0x100, 0x17F), (0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30F6), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


class GatedNetwork:
    """Weights by name: for each direction the input table I (256 x 3H), the recurrent U (H x 3H); output V, c."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, self.least = languages, hidden, 0.0
        self.w = {f"I{d}": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32) for d in "fb"}
        self.w |= {f"U{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32) for d in "fb"}
        self.w |= {"V": rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (time, row, H) of one direction over bytes ``x`` (time, row); masked positions keep the state before."""
        h_n, table, u = self.hidden, self.w[f"I{d}"], self.w[f"U{d}"]
        out = np.empty((*x.shape, h_n), np.float32)
        h = np.zeros((x.shape[1], h_n), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            i, r = table[x[t]], h @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * (i[:, : 2 * h_n] + r[:, : 2 * h_n]))  # update, reset
            cand = np.tanh(i[:, 2 * h_n :] + gates[:, h_n:] * r[:, 2 * h_n :])
            step = (1 - gates[:, :h_n]) * (cand - h) * mask[t][:, None]
            if trace is not None:
                trace.append((t, h, gates, cand, r[:, 2 * h_n :]))
            h = h + step
            out[t] = h
        return out

    def _reading(self, x: np.ndarray, mask: np.ndarray, d: str) -> np.ndarray:
        """``states`` for prediction, as (time, H, row): the same numbers, computed in place."""
        n, (steps, rows) = self.hidden, x.shape
        table, u = self.w[f"I{d}"].T.copy(), self.w[f"U{d}"].T.copy()
        table[: 2 * n] *= 0.5  # a gate is half of one plus tanh of half its input
        u[: 2 * n] *= 0.5
        out, h, full = np.empty((steps, n, rows), np.float32), np.zeros((n, rows), np.float32), mask.all(1)
        i, r, gates, step = (np.empty((k * n, rows), np.float32) for k in (3, 3, 2, 1))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=i, mode="clip")
            np.matmul(u, h, out=r)
            np.add(i[: 2 * n], r[: 2 * n], out=gates)
            np.tanh(gates, out=gates)
            gates += 1
            np.multiply(gates[n:], r[2 * n :], out=step)
            step *= 0.5
            step += i[2 * n :]
            np.tanh(step, out=step)
            step -= h
            step *= np.subtract(2, gates[:n], out=gates[:n])
            step *= 0.5
            if not full[t]:
                step *= mask[t]
            h = np.add(h, step, out=out[t])
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, language, row): the label of every position."""
        v = self.w["V"].T.copy()
        x = x.astype(np.intp)
        z = v[:, : self.hidden] @ self._reading(x, mask, "f")
        z += v[:, self.hidden :] @ self._reading(x, mask, "b")
        z += self.w["c"][:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over unmasked positions; ``y``: the language of each row."""
        n, traces = self.hidden, {"f": [], "b": []}
        s = np.concatenate([self.states(x, mask, d, traces[d]) for d in "fb"], -1)
        z = s @ self.w["V"] + self.w["c"]
        z = np.exp(z - z.max(-1, keepdims=True))
        z /= z.sum(-1, keepdims=True)
        z[:, np.arange(y.size), y] -= 1
        z *= (mask / mask.sum())[:, :, None]
        g = {"V": np.einsum("tbh,tbl->hl", s, z), "c": z.sum((0, 1))}
        ds = z @ self.w["V"].T
        for d, part in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
            u = self.w[f"U{d}"]
            gi, gu, dh = np.zeros_like(self.w[f"I{d}"]), np.zeros_like(u), 0
            for t, h, gates, cand, rc in reversed(traces[d]):
                dh = dh + part[t]
                m = mask[t][:, None]
                up, reset = gates[:, :n], gates[:, n:]
                dcand = dh * m * (1 - up) * (1 - cand**2)
                dup = dh * m * (h - cand) * up * (1 - up)
                dreset = dcand * rc * reset * (1 - reset)
                da = np.concatenate((dup, dreset, dcand), 1)
                dr = np.concatenate((dup, dreset, dcand * reset), 1)
                np.add.at(gi, x[t], da)
                gu += h.T @ dr
                dh = dh * (1 - m * (1 - up)) + dr @ u.T
            g[f"I{d}"], g[f"U{d}"] = gi, gu
        return g

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> None:
        """Adam on balanced batches; ``x``, ``mask``: (row, time)."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, max(1, batch // len(rows))) for r in rows])
            for k, g in self.gradients(x[pick].T, mask[pick].T, y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (rate * (1 - 0.9 * step / steps) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def _pad(pieces: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(pieces), width), np.uint8), np.zeros((len(pieces), width), np.float32)
    for i, p in enumerate(pieces):
        x[i, : p.size], mask[i, : p.size] = p, 1
    return x, mask


def foreign(sample: list[str], n: int, seed: int = 2) -> list[str]:
    """``n`` windows of letters in no language of ``sample``: random words, codes, repeats, ciphers of the sample, scripts it does not use."""
    rng = np.random.default_rng(seed)
    seen = np.array([ord(c) for t in sample for c in t.lower() if c.isalpha()])
    scripts = [s for s in SCRIPTS if ((seen >= s[0]) & (seen <= s[1])).sum() <= 0.001 * seen.size]
    latin = "abcdefghijklmnopqrstuvwxyz"

    def drawn(letters: str, k: int = WINDOW) -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), k))

    def worded(letters: str) -> str:
        return " ".join(drawn(letters, int(k)) for k in rng.integers(1, 11, WINDOW // 2))[:WINDOW]

    def script() -> str:
        if not scripts:
            return worded(latin)
        first, last = scripts[rng.integers(len(scripts))]
        letters = "".join(map(chr, rng.integers(first, last + 1, WINDOW)))
        return worded(letters + latin if first == 0x100 else letters)

    def cipher() -> str:
        return sample[rng.integers(len(sample))].lower().translate(str.maketrans(latin, "".join(rng.permutation(list(latin)))))

    kinds = (lambda: worded(latin), lambda: drawn(latin + latin + "0123456789+/"), lambda: drawn("0123456789abcdef"), lambda: drawn(latin, int(rng.integers(1, 4))) * WINDOW, script, script, cipher)
    return [kinds[i % len(kinds)]() for i in range(n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> GatedNetwork | None:
    """A network trained on the bounded sample of labelled documents that are not held out; None without any."""
    labelled = docs.where((F.col("lang") != UNKNOWN) & ~held_out(F.col("doc_id")) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is lang a language?")
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, PER_LANGUAGE / n))])
    drawn = labelled.where(hash01(F.col("doc_id")) < share[F.col("lang")] * float(1 << 60))
    width = F.greatest(F.lit(0), F.length("text") - WINDOW)
    windows = F.array(*[F.substring("text", F.floor(width * (i / max(1, WINDOWS - 1))).cast("int") + 1, F.lit(WINDOW)) for i in range(WINDOWS)])
    # rows of one id count once, so that the sample stays bounded whatever is repeated
    once = drawn.select("lang", "doc_id", windows.alias("w")).groupBy("lang", "doc_id").agg(F.min("w").alias("w"))
    sample = sorted((r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, *r["w"]) for r in once.collect())
    languages = sorted({r[0] for r in sample})
    if not languages:
        return None
    pieces = [(languages.index(r[0]), encoded(w)[:WINDOW], i) for i, r in enumerate(sample) for w in r[2:] if w]
    others = [encoded(t)[:WINDOW] for t in foreign([w for r in sample for w in r[2:] if w], WINDOWS * PER_LANGUAGE)]
    net = GatedNetwork([*languages, UNKNOWN])
    net.train(*_pad([*(p for _, p, _ in pieces), *others], WINDOW), np.array([k for k, _, _ in pieces] + [len(languages)] * len(others)))
    net.least = _least(net, pieces, len(sample))
    return net


def _least(net: GatedNetwork, pieces: list[tuple[int, np.ndarray, int]], n: int) -> float:
    """The threshold that all but ``MISSED`` of the ``n`` documents that are labelled rightly reach; pieces are (language, bytes, document)."""
    total, size, label = np.zeros((n, len(net.languages))), np.zeros(n), np.zeros(n, int)
    for at in range(0, len(pieces), SIDE_BY_SIDE):
        k, parts, owner = (list(c) for c in zip(*pieces[at : at + SIDE_BY_SIDE], strict=True))
        x, mask = _pad(parts, WINDOW)
        p = net.probabilities(np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T))
        np.add.at(total, owner, np.einsum("tlb,bt->bl", p, mask))
        np.add.at(size, owner, mask.sum(1))
        label[owner] = k
    p = total[:, :-1] / np.maximum(size, 1)[:, None]
    right = p.sum(1)[(size > 0) & (p.argmax(1) == label)]
    return min(MOST, float(np.quantile(right, MISSED))) if right.size else 0.0


def _predicted(net: GatedNetwork, reject: bool = False):
    """(doc_id, held_out, text) -> (doc_id, held_out, lang_pred, score); with ``reject``, und for what the network doesn't know."""

    learned = [k for k, name in enumerate(net.languages) if name != UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = np.zeros((batch.num_rows, len(net.languages))), np.zeros(batch.num_rows)
            pieces: list[np.ndarray] = []
            owner: list[int] = []

            def flush() -> None:
                x, mask = _pad(pieces, max(p.size for p in pieces))
                p = net.probabilities(np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T))
                np.add.at(total, owner, np.einsum("tlb,bt->bl", p, mask))
                np.add.at(size, owner, mask.sum(1))
                pieces.clear()
                owner.clear()

            for i, text in enumerate(batch.column(2)):
                raw = encoded(text.as_py() or "")
                for part in np.array_split(raw, -(-raw.size // PIECE)) if raw.size else []:
                    pieces.append(part)
                    owner.append(i)
                    if len(pieces) == SIDE_BY_SIDE:
                        flush()
            if pieces:
                flush()
            p = total[:, learned] / np.maximum(size, 1)[:, None]
            best = p.argmax(1)
            score = np.clip(p[np.arange(best.size), best], 0, 1)
            known = (size > 0) & ((p.sum(1) >= net.least) | (not reject))
            lang = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(np.where(size > 0, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: GatedNetwork | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).cast("string")  # others are und
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), lettered.alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predicted(net), "doc_id bigint, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, net: GatedNetwork | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language the network knows (see ``least`` of the network), with a score of at least ``least``."""
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lettered = F.when(F.col("row.text").rlike(r"\p{L}"), F.col("row.text")).cast("string")
    rows = packed(docs).select("row", lettered.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nothing = pa.nulls(batch.num_rows, pa.bool_())
            judged = next(_predicted(net, reject=True)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), nothing, batch.column(1)], ["doc_id", "held_out", "text"])])))
            keep = [p != UNKNOWN and s >= least for p, s in zip(judged.column(2).to_pylist(), judged.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["row"])

    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
