"""Near-copies by HyperMinHash.

A document's set is its distinct word shingles. Sets are condensed to REGISTERS registers; each
holds the smallest hash of the shingles that fall into it, compressed to its count of leading
zeros (6 bits) and MANTISSA bits after them. A register that no shingle falls into is filled
from further rounds of hashing, the last of which offers every shingle to every register; the
winner is always the first in an order over (round, hash) that all sets share, so two registers
agree with the probability of the Jaccard similarity, for small sets too.

1. Equal sets are one class (128-bit fingerprint of the whole set), so copies never form pairs;
   all that follows is between classes.
2. Bands of the compressed registers are the buckets. A bucket's smallest member is its pivot
   and is paired with the members of other components; never are all pairs of a bucket made.
   Large buckets are dealt in parts, each of which gets the pivot.
3. A pair goes on if its collision-corrected Jaccard estimate is near enough; it is a link if
   the whole sets, made again from the whole texts, reach the threshold. A text is sent once for
   each pair that it is the member of; a pivot's, once for every PART_ROWS pairs.
4. Links merge components. The pivot leaves its bucket; a bucket whose other members are all
   in one component is done, the rest go round again with a new pivot. A round makes at most
   one pair for each member. Pairs that are left in small buckets are then compared in one go.
5. What PIVOT_TURNS rounds leave in large buckets (texts that are alike, but not enough) is
   compared in bounded blocks, whose tasks return links only, at most one for each document.

A pair at the threshold misses all buckets with probability (1 - t^5)^25: 4e-7 at 0.85, 5e-5 at 0.8.

Defined cases: null and empty texts, and texts without words, have an empty set and stay alone;
a text shorter than a shingle is one shingle; repeated rows get equal results; rows that share an
id but not the text are one document, which all their links join; rows whose id is null get no
component and are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import materialize
from tablemill.llm.graph import components
from tablemill.llm.wordhash import WordHashes, mixed, runs

SHINGLE, SIMILARITY = 5, 0.85
REGISTERS, BANDS, ROWS, MANTISSA, ROUNDS = 128, 25, 5, 10, 3
#: Chance that registers of different shingles agree: equal zeros (1/3) and equal mantissas.
COLLISION = 1 / 3 / 2**MANTISSA
#: Estimates pass down to four standard deviations under the threshold.
MARGIN = 4.0
#: Turns of pivots before what is left of large buckets is dealt into narrower ones.
PIVOT_TURNS = 2
#: Rows of a bucket, and pairs of a pivot, that are dealt out as one part.
PART_ROWS = 1_000
#: A block of a group that is compared as a whole.
BLOCK_ROWS, BLOCK_BYTES = 512, 1_000_000


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z in lower case."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.of(words)
    return np.unique(runs(own, min(size, len(words))) + np.uint64(min(size, len(words))))


def compressed(values: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros of bits-wide values and the bits after the first one, in 16 bits."""
    part, power = np.frexp(values.astype(np.float64) + 0.5)
    zeros = np.clip(bits - power, 0, 63).astype(np.uint16)
    tail = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | np.minimum(tail, (1 << MANTISSA) - 1)


def registers(shingles: np.ndarray) -> np.ndarray:
    slot = np.uint64(REGISTERS.bit_length() - 1)
    shift = np.uint64(64) - slot
    out, empty = np.zeros(REGISTERS, np.uint64), np.ones(REGISTERS, bool)
    for t in range(ROUNDS):
        keys = np.sort(mixed(shingles + np.uint64(0xD1B54A32D192ED03 * (t + 1) % 2**64)))
        at = (keys >> shift).astype(np.int64)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        at, keys = at[first], keys[first]
        new = empty[at]
        out[at[new]] = keys[new] & ((np.uint64(1) << shift) - np.uint64(1))
        empty[at] = False
        if not empty.any():
            break
    for j in np.flatnonzero(empty):
        out[j] = (mixed(shingles ^ mixed(np.array([j + 1000], np.uint64))) >> slot).min()
    return compressed(out, int(shift))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows, without the expected chance agreements."""
    return np.maximum(0, ((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc, h (a hash of the text), n, print and regs for rows (doc, t, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, prints, regs = [], [], []
                for t in batch.column(1).to_pylist():
                    s = shingle_set(t, hashes, size)
                    n.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], ["doc", "h", "n", "print", "regs"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, h binary, n long, print binary, regs binary")


def alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ra, rb) whose estimate is near enough."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_048):
                batch = whole.slice(at, 2_048)
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b) >= least))

    return pairs.mapInArrow(run, pairs.select("a", "b").schema)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold, in whole numbers. Rows of one a come in
    parts, its own text first in each; what a task holds is one set."""
    parts = round(threshold * 10_000)
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("k"))
    first = counts.join(texts.withColumnRenamed("c", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "t")
    rest = pairs.join(texts.withColumnRenamed("c", "b"), "b").join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "k").alias("part"), "b", "t")
    dealt = first.unionByName(rest)
    dealt = dealt.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = np.empty(0, np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                good = []
                for b, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    x = shingle_set(t, hashes, size)
                    if b is None:
                        own = x
                        good.append(False)
                    else:
                        both = len(np.intersect1d(own, x, assume_unique=True))
                        good.append(10_000 * both >= parts * (len(x) + len(own) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return dealt.mapInArrow(run, pairs.select("a", "b").schema)


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, size: int = SHINGLE, few: int = 8) -> DataFrame:
    """One row for every row of docs: doc, `n_shingles`, `component` (smallest doc reachable by
    links) and `kept` (the document is its component's smallest). few: buckets in which each
    member has at most about so many pairs left are compared pair by pair, larger ones in
    blocks."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("t"))
    source = source.withColumn("h", F.unhex(F.md5("t")))
    sig = materialize(signatures(source, size), "signatures")
    own = sig.where("n > 0 and doc is not null")
    # a class (c) has one text: that of its smallest document, and of that the one with the least hash
    classes = own.groupBy(F.col("print").alias("c")).agg(F.min(F.struct("doc", "h")).alias("first"), F.first("regs").alias("regs"))
    classes = materialize(classes.select("c", "first.doc", "first.h", "regs"), "classes")
    slices = [F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]
    bands = classes.select("c", F.explode(F.array(*slices)).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    parts = F.ceil(F.col("k") / PART_ROWS)
    members = bands.join(shared, "bucket").select("bucket", "c", parts.alias("parts"), F.pmod(F.xxhash64("c"), parts).alias("part"))
    members = materialize(members, "members")
    wanted = members.select("c").distinct()
    texts = source.join(classes.join(wanted, "c").select("c", "doc", "h"), ["doc", "h"]).dropDuplicates(["c"]).select("c", "t")
    texts, regs = materialize(texts, "texts"), classes.select("c", "regs")

    comps = wanted.select("c", F.col("c").alias("comp"))
    turn = 0
    members = members.withColumn("comp", F.col("c"))
    while True:
        turn += 1
        pivots = members.groupBy("bucket").agg(F.min(F.struct("c", "comp")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("parts").alias("parts"))
        pivots = pivots.where("lo < hi").select("bucket", F.col("p.c").alias("a"), F.col("p.comp").alias("ca"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        open_ = members.join(pivots, ["bucket", "part"]).where("c <> a")
        pairs = open_.where("comp <> ca").select("a", F.col("c").alias("b")).distinct()
        comps = merge(comps, confirm(pairs, regs, texts, threshold, size))
        members = materialize(open_.select("bucket", "part", "parts", "c").join(comps, "c"), "members")
        crossing, rows = crossings(members)
        if crossing <= few * rows or turn == PIVOT_TURNS:
            break
    if crossing:
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        left = materialize(members.join(sizes.select("bucket", (F.col("k") > 2 * few + 1).alias("large")), "bucket").select("bucket", "c", "comp", "large"), "left")
        small = left.where("not large")
        other = small.select("bucket", F.col("c").alias("b"), F.col("comp").alias("cb"))
        pairs = small.withColumnRenamed("c", "a").join(other, "bucket").where("a < b and comp <> cb").select("a", "b").distinct()
        comps = merge(comps, confirm(pairs, regs, texts, threshold, size))
        large = left.where("large")
        if not large.limit(1).isEmpty():
            large = materialize(large.select("bucket", "c").join(comps, "c"), "members")
            comps = merge(comps, materialize(dense_links(large, texts, threshold, size), "links"))
    several = own.groupBy("doc").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a < z").select("doc", "a")
    several = materialize(own.join(several, "doc").select("a", F.col("print").alias("b")).where("a <> b"), "several")
    if not several.limit(1).isEmpty():
        lone = several.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(comps, "c", "left_anti")
        comps = merge(materialize(comps.unionByName(lone.select("c", F.col("c").alias("comp"))), "components"), several)
    linked = classes.select("c", "doc").join(comps, "c")
    named = linked.join(linked.groupBy("comp").agg(F.min("doc").alias("component")), "comp").select(F.col("c").alias("print"), "component")
    # classes that share no bucket are their documents' own
    alone = classes.join(comps, "c", "left_anti").select(F.col("c").alias("print"), F.col("doc").alias("component"))
    out = sig.select("doc", "n", "print").join(named.unionByName(alone), "print", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(
        F.col("doc").alias(doc),
        F.col("n").alias("n_shingles"),
        component.alias("component"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"),
    )


def crossings(members: DataFrame) -> tuple[int, int]:
    """Pairs of members of a bucket that lie in different components, and members of buckets
    that have such pairs."""
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
    crossing, rows = sizes.where("n * n > same").agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
    return int(crossing or 0), int(rows or 0)


def dense_links(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links between components among members of large buckets that pivots leave unconnected,
    such as the many variants of one text that are alike but mostly under the threshold.
    Documents that meet in such buckets are a group; a group is cut into blocks of about
    BLOCK_ROWS documents and BLOCK_BYTES, and each pair of blocks is one bounded task, which
    counts the shared shingles of all its documents by matrix products over whole sets and
    returns no pairs but a spanning forest of the links."""
    groups = components(members.join(members.groupBy("bucket").agg(F.min("c").alias("low")), "bucket").select("c", "low"), "c", "low")
    own = members.select("c", "comp").distinct().join(groups.withColumnRenamed("node", "c"), "c").join(texts, "c")
    own = materialize(own.select("c", "comp", F.col("root").alias("g"), "t"), "dense")
    blocks = own.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("t")) / BLOCK_BYTES)).alias("k"))
    placed = own.join(blocks, "g").withColumn("i", F.pmod(F.xxhash64("c"), "k"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = placed.select("g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "c", "comp", "t")
    parts = round(threshold * 10_000)

    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        c, comp = table.column("c").to_pylist(), table.column("comp").to_pylist()
        sets = [shingle_set(t, hashes, size) for t in table.column("t").to_pylist()]
        n = np.array([len(s) for s in sets])
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
        row = np.repeat(np.arange(len(sets)), n)[place >= 0]
        place = place[place >= 0]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            s, e = np.searchsorted(place, [low, low + 4096])
            held = np.zeros((len(sets), 4096), np.float32)
            held[row[s:e], place[s:e] - low] = 1
            both += held @ held.T
        both = both.astype(np.int64)
        found = np.triu(10_000 * both >= parts * (n[:, None] + n[None, :] - both), 1)
        roots = {c: c for c in comp}

        def root(c):
            while roots[c] != c:
                roots[c] = c = roots[roots[c]]
            return c

        out = []
        for x, y in zip(*np.nonzero(found)):
            u, v = root(comp[x]), root(comp[y])
            if u != v:
                roots[max(u, v)] = min(u, v)
                out.append((c[x], c[y]))
        return pa.table([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    # dealt anew, or all blocks of a group would stay where the join by g has put them
    dealt = dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "i", "j")
    return dealt.groupBy("g", "i", "j").applyInArrow(run, "a binary, b binary")


def confirm(pairs: DataFrame, regs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The links among pairs of classes (a, b)."""
    ra, rb = regs.select(F.col("c").alias("a"), F.col("regs").alias("ra")), regs.select(F.col("c").alias("b"), F.col("regs").alias("rb"))
    near = materialize(alike(pairs.join(ra, "a").join(rb, "b").select("a", "b", "ra", "rb"), threshold), "near")
    return materialize(verified(near, texts, threshold, size), "links")


def merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after links: links are contracted to components first."""
    if links.limit(1).isEmpty():
        return comps
    ca, cb = comps.select(F.col("c").alias("a"), F.col("comp").alias("u")), comps.select(F.col("c").alias("b"), F.col("comp").alias("v"))
    roots = components(links.join(ca, "a").join(cb, "b").select("u", "v"), "u", "v").withColumnRenamed("node", "comp")
    return materialize(comps.join(roots, "comp", "left").select("c", F.coalesce("root", "comp").alias("comp")), "components")
