"""Ranked lexical search by Block-Max WAND over shards of documents.

The index. Each task packs the documents that it reads into shards, bounded by SHARD_BYTES of text and
SHARD_DOCS documents, in the order of their ids. A shard has one posting list for each term, in
blocks of BLOCK postings: gaps and frequencies as variable-length bytes, and beside them, readable
without decompression, each block's last document and its highest impact (what a posting of weight 1
would add to a score). All documents and all terms are indexed.

The search. A block of items (bounded by BLOCK_ITEMS and BLOCK_BYTES; as many blocks as it takes)
is broadcast with its terms' weights; the shards' lists of those terms are dealt out by shard. In
a shard an item has a threshold: its tenth best score so far in this task, first taken from documents
of its heaviest lists. Then, for many documents at once rather than one by one,

1. pivot: lists are ordered by their highest possible addition. A document that stands only in
   lists whose additions together stay below the threshold is never a pivot, and so is not looked at.
2. shallow move: the pointers of the other lists are moved by last documents alone. A block, and then
   each pivot document in it, whose sum of block maxima is below the threshold is skipped before
   anything of it is decompressed.
3. deep move: blocks that still hold a pivot are decompressed list by list, the heaviest first; each
   list replaces its block maximum by what it really adds, and documents that fall below the
   threshold leave.

Bounds are whole numbers and only documents strictly below the threshold leave, so ties stay and the
result is exact. A shard's blocks are decompressed once for all items. The best of all tasks meet in
two steps, by item and part, then by item, so no item's candidates are sorted in one task but for
`best` of each part.

Defined cases: null texts and those without a term match nothing and count nowhere; equal scores are
ranked by ascending id, a null id last, and rows that share an id are documents of their own;
repeated items have rows of their own; items without a term, or whose terms no document holds, have
no rows; empty tables give an empty result; ids are whole numbers; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import materialize, union_all

BLOCK = 128
SHARD_BYTES, SHARD_DOCS = 12 << 20, 1 << 16
BLOCK_ITEMS, BLOCK_BYTES = 1_000, 4 << 20
#: Documents of an item's heaviest lists that give the first threshold; pivots looked at together.
SEEDS, PIVOTS = 256, 4_096
#: Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
U32 = np.dtype("<u4")
INDEX = "shard long, term string, n long, last binary, tops binary, ends binary, data binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of documents with a term, and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for t in batch.column(0):
                k = len(terms_of(t.as_py()))
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select(F.col(text).cast("binary")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as variable-length bytes, seven bits each, and the place of each number's first."""
    values = values.astype(np.uint64)
    size = 1 + sum((values >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 6))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        more = np.where(size[here] > k + 1, 0x80, 0)
        out[start[here] + k] = ((values[here] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more.astype(np.uint8)
    return out, start


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 0x80)
    start = np.concatenate([[0], ends[:-1] + 1])
    size = ends - start + 1
    out = (data[start] & 0x7F).astype(np.int64)
    for k in range(1, int(size.max(initial=1))):
        here = np.flatnonzero(size > k)
        out[here] |= (data[start[here] + k] & 0x7F).astype(np.int64) << 7 * k
    return out


def lengths_norm(sizes: list[int], n: int, total: int) -> np.ndarray:
    """m of each document, from its number of terms."""
    return np.array([10 + 90 * k * n // total for k in sizes], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def sliced(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each stretch of a flat array."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def shard_rows(shard: int, docs: list[tuple[int | None, bytes]], n: int, total: int) -> Iterator[pa.RecordBatch]:
    """A shard's documents (term null; ids, without null ones, which come last, as `data`, numbers of
    terms as `ends`) and posting lists."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    numbers = defaultdict(count().__next__)
    each = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) << 32 | d for d, (_, t) in enumerate(docs) for w in [terms_of(t)]]
    sizes = [len(x) for x in each]
    key = np.concatenate(each)
    del each
    key, tf = np.unique(key, return_counts=True)
    term, doc = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    del key
    impact = impacts(tf, lengths_norm(sizes, n, total)[doc])
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    counts = np.diff(np.append(first, len(term)))
    inside = np.arange(len(term)) - np.repeat(first, counts)
    gaps = np.where(inside == 0, doc, doc - np.concatenate([[0], doc[:-1]]) - 1)
    data, place = packed(np.stack([gaps, tf - 1], axis=1).ravel())
    begin = np.flatnonzero(inside % BLOCK == 0)
    end = np.append(begin[1:], len(term))
    ends = np.append(place[::2], len(data))[end]
    own = np.cumsum((counts + BLOCK - 1) // BLOCK)  # where each list's blocks end
    start = place[::2][first]
    ends_in_list = ends - np.repeat(start, np.diff(np.concatenate([[0], own])))
    ids = np.array([d for d, _ in docs if d is not None], "<i8")
    head = [[shard], [None], [len(docs)], [b""], [b""], [np.array(sizes, U32).tobytes()], [ids.tobytes()]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["shard", "term", "n", "last", "tops", "ends", "data"]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(head, kinds)], names)
    rows = [
        pa.array(np.full(len(first), shard)), pa.array(list(numbers), pa.binary()).cast(pa.string()), pa.array(counts),
        sliced(doc[end - 1].astype(U32), own), sliced(np.maximum.reduceat(impact, begin).astype(U32), own), sliced(ends_in_list.astype(U32), own),
        sliced(data, np.append(start[1:], len(data))),
    ]
    whole = pa.RecordBatch.from_arrays(rows, names)
    for at in range(0, whole.num_rows, 20_000):
        yield whole.slice(at, 20_000)


def index(docs: DataFrame, n: int, total: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The lists of all documents, by shard; n and total as `statistics` counts them."""
    source = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = count(TaskContext.get().partitionId() << 32)
        held, size = [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if not terms_of(t[:4096] if t else t) and not terms_of(t):
                    continue
                held.append((d, t))
                size += len(t)
                if size >= SHARD_BYTES or len(held) >= SHARD_DOCS:
                    yield from shard_rows(next(shards), held, n, total)
                    held, size = [], 0
        if held:
            yield from shard_rows(next(shards), held, n, total)

    return source.mapInArrow(run, INDEX)


class Postings:
    """One list of a shard; blocks are decompressed when they are asked for."""

    def __init__(self, weight: int, n: int, last: bytes, tops: bytes, ends: bytes, data: bytes):
        self.n, self.last = n, np.frombuffer(last, U32).astype(np.int64)
        self.tops = np.frombuffer(tops, U32).astype(np.int64) * weight
        self.weight, self.top = weight, int(self.tops.max())
        self.ends, self.data = np.frombuffer(ends, U32).astype(np.int64), np.frombuffer(data, np.uint8)
        self.open = np.zeros(len(self.last), bool)
        #: Documents and additions; those of a closed block stand as its last document.
        self.docs = np.repeat(self.last, np.minimum(BLOCK, n - BLOCK * np.arange(len(self.last))))
        self.adds = np.zeros(n, np.int64)

    def decompress(self, blocks: np.ndarray, m: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        self.open[blocks] = True
        low = np.where(blocks > 0, self.ends[blocks - 1], 0)
        sizes = self.ends[blocks] - low
        data = self.data if len(blocks) == len(self.last) else np.concatenate([self.data[a : a + s] for a, s in zip(low.tolist(), sizes.tolist())])
        values = unpacked(data)
        docs, tf = np.cumsum(values[::2] + 1), values[1::2] + 1
        counts = np.minimum(BLOCK, self.n - BLOCK * blocks)
        begin = np.cumsum(counts) - counts
        before = np.where(blocks > 0, self.last[blocks - 1], -1)
        docs += np.repeat(before - np.where(begin > 0, docs[begin - 1], 0), counts)
        where = np.repeat(BLOCK * blocks - begin, counts) + np.arange(len(docs))
        self.docs[where] = docs
        self.adds[where] = impacts(tf, m[docs]) * self.weight

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that would hold each document (one past the last: none)."""
        return np.searchsorted(self.last, docs)


class Best:
    """The best documents of one item so far."""

    def __init__(self, most: int):
        self.most, self.found, self.least = most, [], 1

    def add(self, docs: list[tuple[int, int | None]]) -> None:
        """(score, id) of further documents."""
        ranked = sorted(self.found + docs, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        self.found = ranked[: self.most]
        if len(self.found) == self.most:
            self.least = self.found[-1][0]


class Shard:
    def __init__(self, row: dict, n: int, total: int):
        self.ids = np.frombuffer(row["data"], "<i8")
        self.m = lengths_norm(np.frombuffer(row["ends"], U32).tolist(), n, total)
        self.lists: dict[str, Postings] = {}

    def id_of(self, doc: int) -> int | None:
        return int(self.ids[doc]) if doc < len(self.ids) else None

    def pivots(self, lists: list[Postings], least: int) -> np.ndarray:
        """Documents of lists that can carry one over the threshold, from blocks that can. lists are ordered by their
        highest additions, lowest first."""
        below = np.cumsum([x.top for x in lists])
        first = int(np.searchsorted(below, least))
        out = []
        for k in range(first, len(lists)):
            own = lists[k]
            low, high = np.concatenate([[0], own.last[:-1] + 1]), own.last
            bound = own.tops.copy()
            for x in lists:
                if x is not own:
                    a, b = np.minimum(x.block_of(low), len(x.last)), np.minimum(x.block_of(high), len(x.last) - 1)
                    tops = np.append(x.tops, 0)
                    # the highest of the blocks a to b; a is past the last where there is none
                    bound += np.maximum.reduceat(tops, np.stack([a, np.maximum(b, a) + 1], axis=1).ravel().clip(max=len(x.tops)))[::2] if len(x.tops) > 1 else tops[a]
            good = np.flatnonzero(bound >= least)
            own.decompress(good, self.m)
            out += [own.docs[BLOCK * b : BLOCK * (b + 1)] for b in good.tolist()]
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)

    def scores(self, lists: list[Postings], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the documents that reach the threshold, and their scores. lists: lowest first."""
        blocks = np.stack([x.block_of(docs) for x in lists])
        bounds = np.stack([np.append(x.tops, 0)[b] for x, b in zip(lists, blocks)])
        score = bounds.sum(axis=0)
        at = np.flatnonzero(score >= least)
        for k in range(len(lists) - 1, -1, -1):
            if not len(at):
                break
            x, b = lists[k], blocks[k][at]
            inside = b < len(x.last)
            x.decompress(np.unique(b[inside]), self.m)
            place = np.minimum(np.searchsorted(x.docs, docs[at]), x.n - 1)
            real = np.where(x.docs[place] == docs[at], x.adds[place], 0)
            score[at] += real - bounds[k][at]
            at = at[score[at] >= least]
        return docs[at], score[at]

    def search(self, terms: list[str], best: Best) -> None:
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: x.top)
        if sum(x.top for x in lists) < best.least:
            return
        seen = np.empty(0, np.int64)
        if best.least == 1:  # nothing to go by yet
            for x in reversed(lists):
                x.decompress(np.arange(min(len(x.last), 1 + SEEDS // BLOCK)), self.m)
                seen = np.union1d(seen, x.docs[: BLOCK * (1 + SEEDS // BLOCK)])
                if len(seen) >= SEEDS:
                    break
            self.take(best, *self.scores(lists, seen, best.least))
        found = np.setdiff1d(self.pivots(lists, best.least), seen, assume_unique=True)
        for start in range(0, len(found), PIVOTS):
            self.take(best, *self.scores(lists, found[start : start + PIVOTS], best.least))

    def take(self, best: Best, docs: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((docs, -scores))[: best.most]
        best.add([(s, self.id_of(d)) for d, s in zip(docs[order].tolist(), scores[order].tolist()) if s > 0])


def in_blocks(items: DataFrame, item: str, text: str) -> DataFrame:
    """Items with their distinct terms, in blocks that can be broadcast."""
    source = items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text"))
    schema = source.drop("text").schema.add("block", "long").add("row", "long").add("terms", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        block, n, size, row = base, 0, 0, count(base)
        for batch in batches:
            blocks, rows, terms = [], [], []
            for t in batch.column(1).to_pylist():
                own = [w.decode() for w in sorted(set(terms_of(t)))]
                mine = sum(map(len, own))
                if n and (n >= BLOCK_ITEMS or size + mine > BLOCK_BYTES):
                    block, n, size = block + 1, 0, 0
                n, size = n + 1, size + mine
                blocks.append(block), rows.append(next(row)), terms.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(rows, pa.int64()), pa.array(terms, pa.list_(pa.string()))], schema.names)

    return source.mapInArrow(run, schema)


def searching(asked: dict[int, list[str]], weights: dict[str, int], n: int, total: int, most: int) -> Callable:
    """The task that searches the shards it is dealt, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {row: Best(most) for row in asked}
        shard, now = None, None

        def finish() -> None:
            if shard is not None:
                for row, terms in asked.items():
                    shard.search(terms, found[row])

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != now:
                    finish()
                    shard, now = None, r["shard"]
                if r["term"] is None:
                    shard = Shard(r, n, total)
                else:
                    shard.lists[r["term"]] = Postings(weights[r["term"]], *(r[c] for c in ("n", "last", "tops", "ends", "data")))
        finish()
        rows = [(row, s, d) for row, b in found.items() for s, d in b.found]
        columns = [[r[k] for r in rows] for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "score", "doc"])

    return run


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(lists: DataFrame, items: DataFrame, n: int, total: int, best: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, `rank`, `doc` and `score` of each item's best documents in an index (as `index` makes it,
    written: it is read once for each block of items)."""
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = materialize(in_blocks(items, item, text), "items")
    out = []
    for (block,) in asked.select("block").distinct().collect():
        rows = {r.row: r.terms for r in asked.where(F.col("block") == block).select("row", "terms").collect() if r.terms}
        terms = spark.createDataFrame([(t,) for t in sorted(set().union(*rows.values()))], "term string")
        used = lists.join(F.broadcast(terms), "term", "left_semi").unionByName(lists.where("term IS NULL")).select(lists.columns)
        used = materialize(used, "lists")
        weights = {r.term: weight_of(n, r.df) for r in used.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).collect()}
        dealt = used.repartition(parts, "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = dealt.mapInArrow(searching(rows, weights, n, total, best), "row long, score long, doc long")
        found = found.withColumn("part", F.spark_partition_id())
        for by in (["row", "part"], ["row"]):
            order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        out.append(found.join(F.broadcast(asked.where(F.col("block") == block).select("row", "item")), "row").select(F.col("item").alias(item), "rank", "doc", "score"))
    if not out:
        return spark.createDataFrame([], asked.select(F.col("item").alias(item)).schema.add("rank", "integer").add("doc", "long").add("score", "long"))
    return union_all(out)


#: The same in SQL.
SQL = r"""
WITH held AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS MATERIALIZED (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM held WHERE len(terms) > 0),
sizes AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
postings AS MATERIALIZED (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY term, n_docs),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
scored AS (SELECT i, item_id, p.r, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * d.n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings p USING (term) JOIN docs d USING (r), sizes GROUP BY i, item_id, p.r, d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
