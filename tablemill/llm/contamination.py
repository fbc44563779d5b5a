"""Benchmark decontamination: a prefix-filtered join of item windows with document texts.

A window is `size` consecutive words of an item (a shorter item is one window). Tokens are ordered
by rarity, by counts over all documents. Containment must be complete, so a window's necessary
prefix is one token: its rarest. Only where that token stands in a document can the window
start, at one known place, if the text does not begin later (the positional bound) nor end
earlier (the length bound); each such place is then verified word by word.

1. Items become a table of distinct windows; their tokens are counted over all documents.
2. Each document sends the places of prefix tokens, with the words around them that a window can
   reach. The table of prefixes joins them by token: Spark broadcasts it where its own size limit
   allows, and else shuffles both sides and splits tokens that are skewed.
3. Verified windows are joined to their items, and spans are merged by windows over each row.

Nothing of the items is on the driver but two filters of FILTER_BITS bits, whatever their number:
they spare most words of most documents the shuffle, and a word that passes by chance finds no
partner in the join. Texts are read twice (counts, then places) and never shuffled; what a row
carries to the end is its keep columns.

Defined cases: null and empty texts have no words; an item without words has no windows; items
without an id or a text are no items; items with equal windows are all reported; repeated rows are
judged each on its own; empty tables give empty results; columns other than those named in
`keep` are left out, and `keep` may not name a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import materialize
from tablemill.llm.wordhash import WordHashes

WINDOW, FILTER_BITS = 10, 1 << 23
#: Distinct words that a task counts before it sends them on.
MOST_COUNTED = 1 << 19
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space; bytes
#: of other characters are kept, so the words are those of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULTS = ("n_words", "spans", "items")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Tokens(WordHashes):
    """Spark's xxhash64 of a word, as an unsigned number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def item_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct (item, window): a window is its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                items, windows = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w = words_of(t)
                    own = {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
                    windows += own
                    items += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary()).cast(pa.string())], ["item", "window"])

    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null and t is not null")
    return rows.mapInArrow(run, "item string, window string").distinct()


def filter_of(tokens: DataFrame) -> np.ndarray:
    """A bit for each value that tokens (token) have below FILTER_BITS: at most 1 MB, in
    pieces of 4 kB, each put together by partial sums."""
    bit = F.col("token").bitwiseAND(FILTER_BITS - 1) + 1
    pieces = tokens.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32_768, 4_096), np.uint8)
    for r in pieces:
        out[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").astype(bool)


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)]


def token_counts(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """(token, n): how often each token that passes the filter stands in all documents; partial
    counts in each task, then one small shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def counted(held: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate(held), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate(n)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = np.unpackbits(shared.value).astype(bool), Tokens()
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = [tokens.of(words_of(t)) for t in whole.slice(at, 1024).column(0).to_pylist()]
                found = np.concatenate(found)
                found = found[passing(found, known)]
                keys, n = counted([keys, found], [n, np.ones(len(found), np.int64)])
                if len(keys) > MOST_COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])
                    keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])

    parts = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "token long, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def tokens_of(windows: DataFrame) -> DataFrame:
    """(window, length, offset, token) of each word of each window."""
    words = F.split("window", " ")
    each = windows.select("window", F.size(words).alias("length"), F.posexplode(words).alias("offset", "word"))
    return each.select("window", "length", "offset", F.xxhash64("word").alias("token"))


def prefixes(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, length, token, offset): each window's rarest token and its first place in it.
    A window with a token that stands in no document is left out."""
    ordered = tokens.join(counts, "token", "left").groupBy("window", "length")
    first = ordered.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("p"))
    return first.where("p.n > 0").select("window", "length", "p.token", "p.offset")


def places(docs: DataFrame, text: str, keep: tuple[str, ...], bits: np.ndarray, size: int) -> DataFrame:
    """A row for every row of docs: `row` (its number), `more` (keep columns), `n_words`, and `places`
    of words that pass the filter: the token, where it stands, and the words from `since` on that
    a window can reach."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    kind = T.ArrayType(T.StructType().add("token", "long").add("place", "integer").add("since", "integer").add("words", "string"))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in keep]).alias("more"), F.col(text).cast("binary").alias("t"))
    found_type = pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32()), ("since", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = np.unpackbits(shared.value).astype(bool), Tokens()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                part = whole.slice(start, 512)
                n, found = [], []
                for t in part.column(2).to_pylist():
                    words = words_of(t)
                    hashes = tokens.of(words)
                    at = np.flatnonzero(passing(hashes, known))
                    n.append(len(words))
                    since = np.maximum(at - size + 1, 0).tolist()
                    found.append([(h, a, s, b" ".join(words[s : a + size]).decode()) for h, a, s in zip(hashes[at].view(np.int64).tolist(), at.tolist(), since)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(found, found_type)], ["row", "more", "n_words", "places"])

    return source.mapInArrow(run, source.drop("t").schema.add("n_words", "long").add("places", kind))


def merged_spans(hits: DataFrame) -> DataFrame:
    """(row, spans): hits (row, start, end) as ranges that don't touch, by start."""
    by_start = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = hits.distinct().withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    islands = new.withColumn("island", F.sum("new").over(by_start)).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW) -> DataFrame:
    """keep columns, `n_words`, `spans` (word ranges inside occurrences of item windows, merged,
    end exclusive) and `items` (ids as strings, sorted) for every row of docs."""
    if set(keep) & set(RESULTS):
        raise ValueError(f"keep names a result column: {sorted(set(keep) & set(RESULTS))}")
    windows = materialize(item_windows(benchmark, item, item_text, size), "windows")
    tokens = materialize(tokens_of(windows.select("window").distinct()), "tokens")
    prefix = materialize(prefixes(tokens, token_counts(docs, text, filter_of(tokens))), "prefixes")
    rows = materialize(places(docs, text, keep, filter_of(prefix), size), "places")
    asked = rows.where(F.size("places") > 0).select("row", "n_words", F.inline("places")).join(prefix, "token")
    start = F.col("place") - F.col("offset")
    asked = asked.withColumn("start", start).where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    hits = asked.where(within(F.col("words"), start - F.col("since"), F.col("length")) == F.col("window"))
    hits = materialize(hits.select("row", "start", (F.col("start") + F.col("length")).alias("end"), "window"), "hits")
    named = hits.select("row", "window").distinct().join(windows, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = merged_spans(hits.select("row", "start", "end")).join(named, "row")
    out = rows.select("row", "more", "n_words").join(found, "row", "left")
    none = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("spans", "array<struct<start:int,end:int>>"), ("items", "array<string>"))]
    return out.select(*[F.col("more")[c].alias(c) for c in keep], "n_words", *none)


def within(words: Column, since: Column, length: Column) -> Column:
    """length words from the since-th on, of words joined by one space."""
    return F.array_join(F.slice(F.split(words, " "), since + 1, length), " ")
