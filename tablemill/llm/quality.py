"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in
time linear in the non-zero features by 2 * sum_{i<j} <v_i, v_j> x_i x_j =
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features of a whole text: the words hashed into BUCKETS (square roots of counts, scaled to unit
length) and the statistics of `structure` (shares of characters by kind, word lengths, repeats
of words and lines, line shapes) with the length as metadata, each cut into overlapping ramps so
that a linear weight can bend.

It is fitted on at most `most_labelled` labelled rows, those with the smallest hash of their id
(a documented bound, so the label rows that are joined by broadcast are bounded too); scoring is
one pass over all texts without a shuffle.

Defined cases: null and empty texts are scored as texts without words; a text whose labels
disagree has their mean as label; without labels of both kinds the score is the label's mean
(0.5 where there is none); repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, RANK, MOST_LABELLED, EPOCHS, BATCH, SEED = 4096, 8, 8_000, 12, 32, 7
#: Knots of the ramps of each statistic.
SHARES = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)
STATISTICS: dict[str, tuple[float, ...]] = {
    "upper": SHARES,
    "digits": SHARES,
    "marks": SHARES,
    "spaces": SHARES,
    "other": SHARES,
    "ends with a mark": SHARES,
    "capital words": SHARES,
    "lone marks": SHARES,
    "distinct words": SHARES,
    "most common word": SHARES,
    "repeated lines": SHARES,
    "lines ending a sentence": SHARES,
    "log words": (0.0, 2.0, 4.0, 6.0, 8.0, 11.0),
    "log chars": (0.0, 3.0, 5.0, 7.0, 9.0, 12.0),
    "word length": (0.0, 3.0, 4.5, 6.0, 8.0, 12.0, 30.0),
    "words a line": (0.0, 2.0, 5.0, 12.0, 30.0, 100.0),
}
STEPS = sum(len(k) - 1 for k in STATISTICS.values())
#: Character kinds by byte: upper, lower, digit, space, mark; bytes over 127 are "other".
KIND = np.array([3 if b in b" \t\n\r\x0b\f" else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 5 if b >= 128 else 4 for b in range(256)], np.int64)


class Features:
    """Feature indices and values of texts; remembers the buckets of up to `most` words."""

    def __init__(self, most: int = 400_000):
        self.buckets: dict[bytes, int] = {}
        self.most = most

    def bucket(self, word: bytes) -> int:
        if len(self.buckets) >= self.most:
            self.buckets.clear()
        self.buckets[word] = out = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return out

    def structure(self, text: bytes, words: list[bytes], counts: Counter) -> list[float]:
        n, k = max(len(text), 1), max(len(words), 1)
        kinds = np.bincount(KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=6)
        lines = [x for x in text.split(b"\n") if x.strip()]
        tails = Counter([w[-1] for w in words])
        marks = sum(c for b, c in tails.items() if KIND[b] == 4 and b not in b".,")
        return [
            kinds[0] / n, kinds[2] / n, kinds[4] / n, kinds[3] / n, kinds[5] / n, marks / k,
            sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / k,
            sum(c for w, c in counts.items() if len(w) == 1 and KIND[w[0]] == 4) / k,
            len(counts) / k, max(counts.values(), default=0) / k,
            1 - len(set(lines)) / max(len(lines), 1),
            sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(len(lines), 1),
            np.log1p(len(words)), np.log1p(len(text)), sum(map(len, words)) / k, len(words) / max(len(lines), 1),
        ]

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or b""
        words = text.split()
        counts = Counter(words)
        known, bucket = self.buckets, self.bucket
        at = np.array([known.get(w) or bucket(w) for w in counts], np.int64)
        got = np.bincount(at, weights=np.fromiter(counts.values(), float, len(counts)), minlength=BUCKETS) if counts else np.zeros(BUCKETS)
        idx = np.flatnonzero(got)
        val = np.sqrt(got[idx])
        val /= max(np.linalg.norm(val), 1.0)
        ramps = []
        for x, knots in zip(self.structure(text, words, counts), STATISTICS.values()):
            ramps.extend(min(1.0, max(0.0, (x - a) / (b - a))) for a, b in zip(knots, knots[1:]))
        return np.concatenate([idx, BUCKETS + np.arange(STEPS)]), np.concatenate([val, ramps])


class Machine:
    """w0, linear weights and factors; fitted by AdaGrad on the logistic loss."""

    def __init__(self, w0: float = 0.0):
        size = BUCKETS + STEPS
        self.w0, self.w = w0, np.zeros(size)
        self.v = np.random.default_rng(SEED).normal(0, 0.01, (size, RANK))

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of texts laid end to end; starts: where each begins (none is empty)."""
        vx = self.v[idx] * val[:, None]
        s, q = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (s * s - q).sum(axis=1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        sizes = [len(i) for i, _ in rows]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def fit(self, rows: list, labels: np.ndarray, rate: float = 0.1, l2: float = 1e-5) -> Machine:
        rng = np.random.default_rng(SEED)
        g0, gw, gv = 1.0, np.full(len(self.w), 1.0), np.full(self.v.shape, 1.0)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                idx, val = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                sizes = np.array([len(rows[i][0]) for i in own])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                vx = self.v[idx] * val[:, None]
                s = np.add.reduceat(vx, starts)
                raw = self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(axis=1)
                err = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[own]
                each = np.repeat(err, sizes)
                used, slot = np.unique(idx, return_inverse=True)
                dw = np.bincount(slot, weights=each * val) + l2 * self.w[used]
                dx = (each * val)[:, None] * (np.repeat(s, sizes, axis=0) - vx)
                dv = np.stack([np.bincount(slot, weights=dx[:, f]) for f in range(RANK)], axis=1) + l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += err.sum() ** 2
                self.w0 -= rate * err.sum() / g0**0.5
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, most_labelled: int = MOST_LABELLED) -> Machine:
    """Fit on labelled rows; learn: a condition on labels' rows (over its doc column)."""
    rows = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.groupBy(F.col(doc).alias("d")).agg(F.avg(label).alias("y"))
    # at most most_labelled rows of two numbers: small enough to broadcast by that bound
    rows = rows.orderBy(F.xxhash64("d"), "d").limit(most_labelled)
    known = docs.select(F.col(doc).alias("d"), F.col(text).cast("binary").alias("t")).join(F.broadcast(rows), "d").select("d", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [features.of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([i.astype(np.int16).tobytes() for i, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary()), part.column(2)],
                    ["d", "i", "x", "y"],
                )

    sample = sorted(known.mapInArrow(run, known.select("d").schema.add("i", "binary").add("x", "binary").add("y", "double")).toLocalIterator(), key=lambda r: (r.d, bytes(r.x)))
    y = np.array([r.y for r in sample])
    mean = float(y.mean()) if len(y) else 0.5
    start = float(np.clip(np.log((mean + 1e-9) / (1 - mean + 1e-9)), -20, 20))
    machine = Machine(start)
    if not len(y) or y.min() == y.max():
        machine.v[:] = 0
        return machine
    return machine.fit([(np.frombuffer(r.i, np.int16).astype(np.int64), np.frombuffer(r.x, np.float32).astype(float)) for r in sample], y)


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `score` (0 to 1) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    source = docs.select(*keep, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = Machine(), Features()
        own.w0, own.w, own.v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = own.score([features.of(t) for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores)], [*keep, "score"])

    return source.mapInArrow(run, source.drop("__text").schema.add("score", "double"))
