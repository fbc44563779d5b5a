"""Chroma audio fingerprints.

A recording (PCM WAV bytes in a column) is cut into overlapping frames; each frame's spectrum is
folded into 12 pitch classes. Sixteen filters of the kinds in `FILTERS` compare sums of
rectangles of the (frame, pitch class) image, taken in constant time from its integral image;
each answer is one of four levels, two Gray-coded bits, so a frame gives a packed 32-bit
integer. Recordings with equal fingerprints are one class. A search joins landmarks and counts
offsets for each pair of classes; every offset that leaves `least_overlap` of the shorter recording is
checked by the share of differing bits over the whole overlap, and of those that pass the one
with the most agreeing bits over chance is the match.

A landmark is of two frames, two frames apart (APART): three of the four bytes of both integers, the
same ones, so each frame has four and errors in one byte leave one. Two frames hold 48 bits, so
unlike recordings hardly ever share one, however many there are; like ones are found by it with up to
MOST_ERRORS differing bits. Landmarks of two bytes at distances of two and four frames (THOROUGH) find
nearly all pairs up to 0.3, at the price of chance matches that grow with the square of the table.
Nothing is gathered in one task: offsets are counted with partial sums, and the bit errors of a
pair need just the two fingerprints.

Defined cases: null, empty or unreadable bytes, a rate or number of channels of 0, and recordings shorter than the widest filter,
have no fingerprint and match nothing; of damaged ones what whole samples there are counts; those of fewer than three frames match only their equals; ties between offsets go to the smaller one; rows that
share an id are classed by their own recordings; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import materialize
from tablemill.llm.wordhash import STEP, mixed

FRAME, HOP, LOWEST, HIGHEST = 1024, 128, 60.0, 2000.0
#: Kind, first pitch class, classes, frames: each filter compares two halves of its rectangle.
FILTERS = tuple((k, c, h, w) for k, c, h, w in zip([0, 1, 2, 3] * 4, [0, 4, 8, 2, 6, 0, 3, 9, 1, 5, 7, 0, 4, 2, 0, 6], [4, 4, 4, 8, 6, 12, 6, 3, 4, 6, 4, 12, 8, 8, 12, 6], [16, 8, 12, 16, 8, 16, 12, 8, 4, 12, 16, 8, 16, 4, 12, 16]))
WIDEST = 16
#: Levels of the log ratio of both halves, and their Gray code.
LEVELS, GRAY = np.array([-0.35, 0.0, 0.35]), np.array([0, 1, 3, 2], np.uint32)
#: Landmarks: distances of their two frames, and bytes of each.
APART, THOROUGH = ((2,), 3), ((2, 4), 2)
#: Share of differing bits up to which landmarks APART find pairs.
MOST_ERRORS = 0.25
#: Share of the shorter recording that a match overlaps at least; 0: any overlap that holds a landmark.
LEAST_OVERLAP = 0.0
#: Recordings or pairs, and frames of a recording, that are worked on at once.
SLICE, BLOCK = 128, 2_048


def pcm(data: bytes | None) -> tuple[np.ndarray, int]:
    """(samples, channels) as they are stored, and the rate, of 8- or 16-bit PCM. A last sample that is cut off
    is left out."""
    none = np.empty((0, 1), np.int16), 1
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError, struct.error):
        return none
    if width not in (1, 2) or channels < 1 or rate < 1:
        return none
    whole = len(raw) // (width * channels) * channels
    return np.frombuffer(raw, "<i2" if width == 2 else np.uint8, whole).reshape(-1, channels), rate


def mono(x: np.ndarray) -> np.ndarray:
    """Stored samples as numbers between -1 and 1."""
    x = x.astype(float) / 32768 if x.dtype.itemsize == 2 else (x.astype(float) - 128) / 128
    return x.mean(axis=1)


HANN = np.hanning(FRAME)


@lru_cache(16)
def folding(rate: int) -> np.ndarray:
    """(frequencies, 12): which pitch class each frequency of a spectrum belongs to."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (f >= LOWEST) & (f <= HIGHEST)
    fold = np.zeros((len(f), 12))
    fold[np.flatnonzero(used), np.round(12 * np.log2(f[used] / 440)).astype(int) % 12] = 1
    return fold


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): energy of each pitch class, frames at unit length, from stored samples. BLOCK frames
    are worked on at once, so a long recording takes little more than its own bytes."""
    n = (len(x) - FRAME) // HOP + 1 if len(x) >= FRAME else 0
    out = np.empty((n, 12))
    for start in range(0, n, BLOCK):
        end = min(n, start + BLOCK)
        part = mono(x[start * HOP : (end - 1) * HOP + FRAME])
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * HANN
        spectrum = np.fft.rfft(frames, axis=1)
        out[start:end] = (spectrum.real**2 + spectrum.imag**2) @ folding(rate)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(data: bytes | None) -> np.ndarray:
    image = chroma(*pcm(data))
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        """Sums over frames [t0, t1) after each start and pitch classes [c0, c1), which wrap."""
        if c1 > 12:
            return area(t0, t1, c0, 12) + area(t0, t1, 0, c1 - 12)
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (kind, c, h, w) in enumerate(FILTERS):
        if kind == 0:
            a, b = area(0, w, c, c + h // 2), area(0, w, c + h // 2, c + h)
        elif kind == 1:
            a, b = area(0, w // 2, c, c + h), area(w // 2, w, c, c + h)
        elif kind == 2:
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
            b = area(0, w // 2, c + h // 2, c + h) + area(w // 2, w, c, c + h // 2)
        else:
            a, b = area(w // 4, w - w // 4, c, c + h), area(0, w // 4, c, c + h) + area(w - w // 4, w, c, c + h)
        out |= GRAY[np.digitize(np.log((1 + a) / (1 + b)), LEVELS)] << np.uint32(2 * k)
    return out


def fingerprints(recordings: DataFrame, key: str, audio: str) -> DataFrame:
    """key and `prints` (little-endian unsigned 32-bit integers; null without any)."""
    source = recordings.select(F.col(key), F.col(audio).alias("__audio"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [fingerprint(x).astype("<u4").tobytes() or None for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], [key, "prints"])

    return source.mapInArrow(run, source.drop("__audio").schema.add("prints", "binary"))


def errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where b, moved by offset, overlaps a; and the overlap."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    x = a[lo:hi] ^ b[lo + offset : hi + offset]
    return float(np.bitwise_count(x).sum()) / (32 * (hi - lo)), hi - lo


def pair_marks(prints: np.ndarray, places: np.ndarray, distance: int, kept: tuple[int, ...]) -> np.ndarray:
    """Landmarks of the frames at places and of those at a distance from them, from the bytes kept of both."""
    mask = np.uint64(sum(0xFF << 8 * k for k in kept))
    a, b = (prints[at].astype(np.uint64) & mask for at in (places, places + distance))
    # landmarks of other bytes and distances are other numbers
    return mixed((a << np.uint64(32) | b) + np.uint64(distance) * STEP + mask).view(np.int64)


def classes(prints: DataFrame, key: str) -> DataFrame:
    """For each distinct fingerprint its smallest key as `rep`, and whether other keys have it (`copied`)."""
    found = prints.where(F.col("prints").isNotNull() & F.col(key).isNotNull()).groupBy("prints")
    return found.agg(F.min(key).alias("rep"), (F.min(key) < F.max(key)).alias("copied"))


def search(prints: DataFrame, queries: DataFrame, key: str, most_errors: float = MOST_ERRORS, least_overlap: float = LEAST_OVERLAP, marks: tuple[tuple[int, ...], int] = APART) -> DataFrame:
    """Matches of query classes with all classes of prints: `query`, `match` (representatives),
    `offset` of the match's frames against the query's, `overlap` and `error`. A query class
    matches itself, at offset 0 without errors, if it has other keys. prints and queries are
    results of `fingerprints`; a class has one representative, the smallest key of both."""
    named = materialize(classes(prints.select(key, "prints").unionByName(queries.select(key, "prints")), key), "classes")
    all_ = materialize(named.join(prints.select("prints"), "prints", "left_semi"), "prints")
    asked = materialize(named.join(queries.select("prints"), "prints", "left_semi"), "queries")

    distances, kept = marks[0], list(combinations(range(4), marks[1]))

    def landmarks(df: DataFrame, name: str, place: str) -> DataFrame:
        kind = df.schema["rep"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(start, SLICE)
                    rep, p = batch.column("rep"), batch.column("prints").to_pylist()
                    sizes = np.array([len(x) // 4 for x in p], np.int64)
                    each = np.frombuffer(b"".join(p), "<u4")
                    row, where = np.repeat(np.arange(len(p)), sizes), np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    # of each distance, the frames that have another that far on
                    firsts = [(d, np.flatnonzero(where + d < sizes[row])) for d in distances]
                    found = np.concatenate([pair_marks(each, at, d, c) for d, at in firsts for c in kept])
                    at = np.concatenate([at for _, at in firsts for _ in kept])
                    out = [rep.take(pa.array(row[at])), pa.array(found), pa.array(where[at].astype(np.int32)), pa.array(sizes[row[at]].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(out, [name, "mark", f"{place}p", f"{place}n"])

        return df.mapInArrow(run, f"{name} {kind}, mark long, {place}p int, {place}n int")

    offset = F.col("mp") - F.col("qp")
    overlap = F.least("qn", F.col("mn") - offset) - F.greatest(F.lit(0), -offset)
    near = (F.col("query") != F.col("match")) & (overlap >= least_overlap * F.least("qn", "mn"))
    hits = landmarks(asked, "query", "q").join(landmarks(all_, "match", "m"), "mark").where(near)
    pairs = hits.groupBy("query", "match", offset.alias("offset")).agg(F.count(F.lit(1)).alias("votes")).select("query", "match", "offset")
    both = pairs.join(asked.select(F.col("rep").alias("query"), F.col("prints").alias("qx")), "query").join(all_.select(F.col("rep").alias("match"), F.col("prints").alias("mx")), "match")
    both = both.select("query", "match", "offset", "qx", "mx")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                got = [errors(np.frombuffer(q, "<u4"), np.frombuffer(m, "<u4"), o) for o, q, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
                out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([n for _, n in got], pa.int64()), pa.array([e for e, _ in got], pa.float64())], ["query", "match", "offset", "overlap", "error"])
                yield out.filter(pa.array([e <= most_errors for e, _ in got], pa.bool_()))

    found = both.mapInArrow(compare, both.select("query", "match", "offset").schema.add("overlap", "long").add("error", "double"))
    agreeing = F.col("overlap") * (1 - 2 * F.col("error"))
    best = found.groupBy("query", "match").agg(F.max(F.struct(agreeing, -F.abs("offset"), "offset", "overlap", "error")).alias("b"))
    found = best.select("query", "match", "b.offset", "b.overlap", "b.error")
    frames = (F.octet_length("prints") / 4).cast("long")
    return found.unionByName(asked.where("copied").select(F.col("rep").alias("query"), F.col("rep").alias("match"), F.lit(0).alias("offset"), frames.alias("overlap"), F.lit(0.0).alias("error")))


def rendered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rate: int = 4000, note: int = 256) -> DataFrame:
    """A WAV recording for each vector, one note for each number, its pitch by its size: a
    column of media for tables that have none."""
    source = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([wav(v, rate, note) for v in part.column(1).to_pylist()], pa.binary())], [key, "audio"])

    return source.mapInArrow(run, source.drop("__v").schema.add("audio", "binary"))


def wav(vector: list | None, rate: int, note: int) -> bytes | None:
    if not vector:
        return None
    v = np.nan_to_num(np.array([x if x is not None else 0.0 for x in vector], float))
    steps = np.round(np.clip(v, -0.5, 0.5) * 48)
    phase = np.cumsum(np.repeat(2 * np.pi * 330.0 * 2 ** (steps / 12) / rate, note))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.sin(phase) * 20000).astype("<i2").tobytes())
    return out.getvalue()
