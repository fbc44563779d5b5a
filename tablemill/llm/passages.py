"""Repeated passages by relative Lempel-Ziv parsing over content-defined reference blocks.

A document is parsed greedily from left to right into factors: at each place the factor that
reaches furthest, a stretch of words that the reference (all that comes earlier in the corpus)
holds too, given as (start, end, source document, place there). Windows of `size` words lie
inside factors or across the boundary of two; spans of factors are the duplicate spans.

The corpus is far too large for one suffix structure, so the reference is indexed in blocks that
the text itself delimits: each window of `size` words is assigned to its minimiser, the smallest
hash among its GRAM-word grams, and a block is a run of windows with the same minimiser. Equal
windows have equal minimisers wherever they stand, so a window's earlier occurrences all lie in
blocks of the same minimiser.

1. Blocks are dealt out by minimiser and looked up in the index by the hash of all their words; the
   index keeps where each first stands. A block that also starts earlier is a match, and
   consecutive matches with the same source and distance are one longer match: factors run
   through blocks.
2. Factors begin and end inside blocks only where blocks of one minimiser differ. There, at the
   factor boundaries, the windows of one copy of each such block are looked up one by one, and
   what matches lengthens the factors beside them.
3. The matches of a document are parsed: the factor that reaches furthest from the end of the last.

Blocks that repeat inside a batch are settled there before the shuffle, so a passage that
stands in a third of all documents sends one row for each batch. Groups are read as sorted
streams with constant memory. The texts are dealt out by document once.

Defined cases: null and short texts have no window and keep all words; a text's own earlier
windows count; rows that share an id are parsed each by itself and are places of one document, so an
equal window of a later start in any of them is removed and neither copy at an equal start is
earlier; equal rows have equal results; rows with a null id keep all words and are no reference; ids are
whole numbers; an empty table gives an empty result; other columns are left out unless named in
`keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import materialize
from tablemill.llm.wordhash import Spans, WordHashes, mixed, runs

WINDOW, GRAM = 20, 5
COVERED, BOUNDARY = 1, 2
SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FACTORS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("source", "long").add("at", "integer"))
FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("at", pa.int32())]))
#: row: hash of id and text, which tells rows of one id apart; source, at: of a covered row, where the reference
#: holds its words.
NAMES = ["anchor", "block", "row", "doc", "start", "n", "kind", "source", "at"]
ROWS = "anchor long, block long, row long, doc long, start int, n int, kind int, source long, at int"
FOUND = "row long, doc long, start int, n int, kind int, source long, at int"


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest gram (the leftmost of equal ones) of each width grams: sliding
    minima by doubling, over keys that hold half a hash and the place."""
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def blocks(hashes: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash, first window and number of windows of each block of a text."""
    grams = runs(hashes, GRAM)
    place = minimisers(grams, size - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]])
    whole = Spans(hashes).of(first, last + size - 1)
    offset = (place[first] - first).astype(np.uint64)
    return grams[place[first]], mixed(whole + offset), first, last - first


def settled(anchor: np.ndarray, block: np.ndarray, row: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Rows of a batch; of blocks that repeat in it only the earliest is still open, the rest
    are covered and get anchors of their own, so that they spread."""
    order = np.lexsort((start, doc, block))
    anchor, block, row, doc, start, n = (x[order] for x in (anchor, block, row, doc, start, n))
    new = np.concatenate([[True], block[1:] != block[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (doc == doc[lead]) & (start == start[lead])
    # rows at the lead's own place are kept if they are other rows, for they may hold boundaries
    covered, twin = ~new & ~same, ~new & same & (row != row[lead])
    anchor = np.where(covered, mixed(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), anchor)
    keep = new | covered | twin
    source, at = np.where(covered, doc[lead], 0), np.where(covered, start[lead], 0).astype(np.int32)
    return [x[keep] for x in (anchor.view(np.int64), block.view(np.int64), row, doc, start.astype(np.int32), n.astype(np.int32), covered.astype(np.int32), source, at)]


def tables(columns: list[np.ndarray], names: list[str], size: int = 65_536) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)


def indexed(docs: DataFrame, size: int) -> DataFrame:
    """The blocks of all texts (row, doc, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            got = []
            for r, d, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = t.split() if t else []
                if len(words) >= size:
                    a, b, s, n = blocks(hashes.of(words), size)
                    got.append((a, b, np.full(len(a), r, np.int64), np.full(len(a), d, np.int64), s, n))
            if got:
                yield from tables(settled(*(np.concatenate(x) for x in zip(*got))), NAMES)

    return docs.mapInArrow(run, ROWS)


def compared(rows: DataFrame) -> DataFrame:
    """(row, doc, start, n, kind, source, at) of covered rows, whose source is the block's first row,
    and of the first rows of unlike blocks that share an anchor (boundaries). Other rows at a first row's
    place, of the same id, cover nothing and are boundaries too. Rows are dealt out by anchor and read in order;
    what is carried from batch to batch is one row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "block", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc", "start", "n", "kind", "source", "at"]
        carried = None  # the last block's first row
        lone = False  # whether that row is its anchor's only block so far
        for batch in batches:
            a, b, r, d, s, n, k, source, at = (batch.column(i).to_numpy() for i in range(9))
            done = k == COVERED
            if done.any():
                yield from tables([x[done] for x in (r, d, s, n, k, source, at)], names)
                a, b, r, d, s, n = (x[~done] for x in (a, b, r, d, s, n))
            if not len(a):
                continue
            if carried is not None:
                a, b, r, d, s, n = (np.concatenate([[c], x]).astype(x.dtype) for c, x in zip(carried, (a, b, r, d, s, n)))
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            first = np.flatnonzero(new)
            lead = first[np.cumsum(new) - 1]
            later = (d != d[lead]) | (s != s[lead])
            twin = ~later & (r != r[lead])
            same = a[first][1:] == a[first][:-1]
            edge = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if carried is not None and not lone:  # said before, or to be said by others only
                edge[0] = False
            out = np.concatenate([np.flatnonzero(later), first[edge], np.flatnonzero(twin)])
            kind = np.concatenate([np.full(later.sum(), COVERED), np.full(edge.sum() + twin.sum(), BOUNDARY)]).astype(np.int32)
            if len(out):
                yield from tables([r[out], d[out], s[out], n[out], kind, d[lead[out]], s[lead[out]]], names)
            z = first[-1]
            fresh = len(first) > 1
            lone = not edge[-1] if fresh or carried is None else lone and not edge[0]
            carried = (a[z], b[z], r[z], d[z], s[z], n[z])

    return dealt.mapInArrow(run, FOUND)


def boundary_windows(docs: DataFrame, size: int) -> DataFrame:
    """Single windows of the boundary blocks of texts (row, doc, t, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            got = []
            for r, d, t, marks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = [(m["start"], m["n"]) for m in marks]
                start = np.concatenate([np.arange(s, s + n) for s, n in own])
                h = Spans(hashes.of(t.split())).of(start, start + size)
                got.append((h, h, np.full(len(h), r, np.int64), np.full(len(h), d, np.int64), start, np.ones(len(h), np.int64)))
            if got:
                yield from tables(settled(*(np.concatenate(x) for x in zip(*got))), NAMES)

    return docs.mapInArrow(run, ROWS)


def parsed(marks: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """A document's factors (start, end, source, at), from matches (start, windows, source, at).
    Matches that follow each other at the same distance from the same source are one."""
    runs: list[list[int]] = []
    for source, move, start, n in sorted((source, at - start, start, n) for start, n, source, at in marks):
        if runs and runs[-1][2:] == [source, move] and start + size - 1 <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + n + size - 1)
        else:
            runs.append([start, start + n + size - 1, source, move])
    runs.sort()
    out: list[tuple[int, int, int, int]] = []
    place = i = 0
    furthest = [0, 0, 0, 0]
    while True:
        while i < len(runs) and runs[i][0] <= place:
            furthest = max(furthest, runs[i], key=lambda r: r[1])
            i += 1
        if furthest[1] > place:
            out.append((place, furthest[1], furthest[2], place + furthest[3]))
            place = furthest[1]
        elif i < len(runs):
            place = runs[i][0]
        else:
            return out


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc and keep columns, `n_words`, `factors` (start, end, source, at: words of this document that
    stand in the source from at on), `spans` (word ranges of factors, merged, end exclusive) and
    `kept` (the other words joined by one space) for every row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("binary").alias("t"), F.struct(F.lit(0), *keep).alias("more"))
    # a number for rows with null ids too, so that they don't meet in one task
    source = named.withColumn("row", F.xxhash64("doc", "t"))
    found = materialize(compared(indexed(source.where("doc is not null").select("row", "doc", "t"), size)), "matches")
    dealt = source.repartition(parts, "row")
    match = F.struct("doc", "start", "n", "kind", "source", "at")
    lists = lambda marks, name: marks.groupBy("row").agg(F.collect_list(match).alias(name)).hint("shuffle_hash")
    marked = dealt.join(lists(found, "marks"), "row", "left")
    # hashes of rows with unlike ids may be equal
    own = lambda name, kind: F.coalesce(F.filter(name, lambda m: (m["doc"] == F.col("doc")) & (m["kind"] == kind)), F.array())
    open_ = marked.where("doc is not null").select("row", "doc", "t", own("marks", BOUNDARY).alias("marks")).where("size(marks) > 0")
    joined = marked.join(lists(compared(boundary_windows(open_, size)), "single"), "row", "left")
    both = F.concat(own("marks", COVERED), own("single", COVERED))
    source = joined.select("doc", "t", F.when(F.col("doc").isNotNull(), both).alias("marks"), "more")
    schema = source.select("doc", "more").schema.add("n_words", "long").add("factors", FACTORS).add("spans", SPANS).add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                count, factors, spans, kept = [], [], [], []
                for t, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = t.split() if t else []
                    count.append(len(words))
                    own = parsed([(m["start"], m["n"], m["source"], m["at"]) for m in marks or []], size)
                    factors.append(own)
                    spans.append(merged([(f[0], f[1]) for f in own]))
                    for s, e in reversed(spans[-1]):
                        del words[s:e]
                    kept.append(b" ".join(words).decode())
                columns = [pa.array(count, pa.int64()), pa.array(factors, FACTOR), pa.array(spans, SPAN), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), *columns], schema.names)

    out = source.mapInArrow(run, schema)
    return out.select(F.col("doc").alias(doc), *[F.col("more")[c].alias(c) for c in keep], "n_words", "factors", "spans", "kept")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
