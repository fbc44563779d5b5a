"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model of order 3 over words and an end token, smoothed by Dirichlet
priors: p(w | v) = (c(vw) + K2 p(w)) / (c(v) + K2), p(w | uv) = (c(uvw) + K3 p(w | v)) / (c(uv) + K3),
p(w) = (c(w) + 1) / (N + V + 1). As an automaton (`Automaton`), histories with a count are states;
an arc carries the log-probability of a seen continuation and leads to the longest seen history
that ends with it; a failure arc leads to the shorter history and carries the left-over mass,
log K / (c + K); the root has an arc for every word. A text is scored in one traversal from left
to right that carries the state, follows failure arcs until the next word has an arc, and adds
up what the arcs carry. Every word of a training text has n-grams of its own; all other words
are one unknown word, so the probabilities of all words and of the unknown one add to 1 after
every history.

Counts cover all training texts and grow with them; nothing of them is broadcast or collected
but a few totals. Texts are read once, where they lie, and written as blocks of word numbers (of
about BLOCK_BYTES of text, however well the files compress), in buckets of up to HOME_BLOCKS blocks
of a task, so that texts are never shuffled. A block's distinct words, then its bigrams, then its trigrams are summed up in hash
ranges, and the totals come back to the blocks that asked, packed as arrays; so each block builds
just the part of the automaton that its own texts can reach, in memory bounded by the block. An
n-gram with a part that no other block holds is nowhere else: it is not asked for, and its own
count is its total. A text longer than a block is a block of its own.

Defined cases: null and empty texts are the end token alone; rows with a null id are never
training rows; repeated rows count as often as they stand; an empty table gives an empty result;
without training rows every token has the probability of the unknown word (1); other columns
are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import bucketed, input_bytes, materialize, union_all
from tablemill.llm.wordhash import WordHashes, mixed

BLOCK_BYTES, HOME_BLOCKS, K2, K3 = 4_000_000, 4, 50.0, 20.0
END, BEGIN, UNKNOWN = np.uint64(0x51ED270B35F2A4C7), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
TWO, THREE, STEP = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x9E3779B97F4A7C15)
TEXTS, ASKED = 0, 1
#: Tokens that one lane of a traversal takes. A lane inside a text starts two tokens early, at the
#: root: after them it is in the state that the text's own traversal has there.
LANE, LEAD = 256, 2


def pressed(x: np.ndarray) -> bytes:
    """An array of unsigned integers, byte by byte of its numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def opened(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def packed(home: int, block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> dict[str, list]:
    """Sorted keys (as steps from one to the next) and counts, cut into 2**bits ranges."""
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(ranges, np.arange((1 << bits) + 1))
    used = [r for r in range(1 << bits) if cuts[r + 1] > cuts[r]]
    steps, counts = np.diff(keys, prepend=np.uint64(0)).astype("<u8"), counts.astype("<u4")
    steps[cuts[used]] = keys[cuts[used]]
    blobs = [[pressed(x[cuts[r] : cuts[r + 1]]) for r in used] for x in (steps, counts)]
    return {"home": [home] * len(used), "block": [block] * len(used), "part": used, "keys": blobs[0], "counts": blobs[1]}


ASKED_COLUMNS = [("home", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
ASKED_SCHEMA = "home long, block long, part long, keys binary, counts binary"
#: totals: twice the count, and 1 more if several blocks asked. n, v: tokens and distinct tokens of
#: the range, given in its first row, 0 in the others.
TOLD_SCHEMA = "home long, block long, part long, totals binary, n long, v long"


def asked_table(asked: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(asked[c], k) for c, k in ASKED_COLUMNS})


def summed(asked: DataFrame) -> DataFrame:
    """Total counts of each range, sent back to the blocks in the order in which they asked."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [np.cumsum(opened(x, "<u8"), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([opened(x, "<u4") for x in table.column("counts").to_pylist()])
        keys, place = np.unique(np.concatenate(blobs), return_inverse=True)
        # sums of whole numbers, exact in doubles up to 2**53
        totals = np.bincount(place, weights=counts, minlength=len(keys)).astype("<u8")
        told = 2 * totals + (np.bincount(place) > 1)
        cuts = np.cumsum([0] + [len(x) for x in blobs])
        k = len(blobs)
        return pa.table(
            {
                "home": table.column("home").combine_chunks(),
                "block": table.column("block").combine_chunks(),
                "part": table.column("part").combine_chunks(),
                "totals": pa.array([pressed(told[place[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                "n": pa.array([int(totals.sum())] + [0] * (k - 1), pa.int64()),
                "v": pa.array([int((totals > 0).sum())] + [0] * (k - 1), pa.int64()),
            }
        )

    return asked.groupBy("part").applyInArrow(run, TOLD_SCHEMA)


def unpacked(told: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of what a block asked for at a level, by its sorted keys, and whether other blocks
    asked too."""
    rows = sorted((p, t) for n, p, t in zip(*(told.column(c).to_pylist() for c in ("level", "part", "totals"))) if n == level)
    x = np.concatenate([opened(t, "<u8") for _, t in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
    return x >> 1, (x & 1).astype(bool)


class Totals:
    """What the whole corpus says: tokens, distinct tokens and training texts."""

    def __init__(self, n: int, v: int, texts: int):
        self.n, self.v, self.texts = n, v, texts
        self.z = n + v + 1


def blocked(docs: DataFrame, block_bytes: int, bits: int) -> DataFrame:
    """docs (doc, t, learn) as rows of two kinds: TEXTS, a block's texts end to end as places of
    its words among all of them, sorted by hash; and ASKED, those words in hash ranges with how
    often training texts hold them."""
    kind = docs.schema["doc"].dataType
    schema = T.StructType().add("kind", "integer").add("docs", T.ArrayType(kind)).add("sizes", "binary").add("learn", "binary").add("tokens", "binary")
    schema = T.StructType([*schema, *T._parse_datatype_string(ASKED_SCHEMA)])

    def of(home: int, doc: pa.Array, texts: list[bytes | None], learn: np.ndarray, hashes: WordHashes) -> pa.RecordBatch:
        words = [t.lower().split() if t else [] for t in texts]
        sizes = np.array([len(w) + 1 for w in words], "<u4")
        flat = np.concatenate([x for w in words for x in (hashes.of(w), np.array([END]))])
        keys, place = np.unique(flat, return_inverse=True)
        taught = np.bincount(place[np.repeat(learn, sizes)], minlength=len(keys))
        block = uuid.uuid4().int >> 65
        asked = packed(home, block, keys, taught, bits)
        k = len(asked["part"])
        body = {
            "kind": pa.array([TEXTS] + [ASKED] * k, pa.int32()),
            "docs": pa.ListArray.from_arrays(pa.array([0] + [len(doc)] * (k + 1), pa.int32()), doc, mask=pa.array([False] + [True] * k)),
            "sizes": pa.array([pressed(sizes)] + [None] * k, pa.binary()),
            "learn": pa.array([learn.tobytes()] + [None] * k, pa.binary()),
            "tokens": pa.array([pressed(place.astype("<u4"))] + [None] * k, pa.binary()),
        }
        body |= {c: pa.array([{"home": home, "block": block}.get(c), *asked[c]], t) for c, t in ASKED_COLUMNS}
        return pa.RecordBatch.from_arrays(list(body.values()), schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, size, made, home = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal made, home
            home = uuid.uuid4().int >> 65 if made % HOME_BLOCKS == 0 else home
            made += 1
            whole = pa.concat_batches([x for x, _ in held])
            learn = whole.column(2).to_numpy(zero_copy_only=False)
            return of(home, whole.column(0), [t for _, ts in held for t in ts], learn, hashes)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                held.append((part.select([0, 1, 2]), texts))
                size += sum(len(t or b"") for t in texts)
                if size >= block_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, schema)


class Block:
    """A block's texts as tokens: places of its words, then the unknown word and what stands
    before a text; and its distinct bigrams and trigrams. What is asked for, and what own_ counts
    hold, is sorted by place; what is told, by hash."""

    def __init__(self, rows: pa.Table, told: pa.Table):
        kinds, parts = rows.column("kind").to_pylist(), rows.column("part").to_pylist()
        text = kinds.index(TEXTS)
        self.home, self.id = (rows.column(c)[text].as_py() for c in ("home", "block"))
        self.docs = rows.column("docs").slice(text, 1).combine_chunks().flatten()
        self.sizes = opened(rows.column("sizes")[text].as_py(), "<u4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(np.frombuffer(rows.column("learn")[text].as_py(), bool), self.sizes)
        asked = sorted((parts[i], i) for i, kind in enumerate(kinds) if kind == ASKED)
        words = np.concatenate([np.cumsum(opened(rows.column("keys")[i].as_py(), "<u8"), dtype=np.uint64) for _, i in asked])
        self.hashes = np.concatenate([words, [UNKNOWN, BEGIN]])
        self.told = told
        self.count, shared = unpacked(told, 1)
        self.unknown, self.begin, self.m = len(words), len(words) + 1, len(words) + 2
        name = np.where(self.count > 0, np.arange(len(words)), self.unknown)
        self.tokens = name[opened(rows.column("tokens")[text].as_py(), "<u4")]
        self.count, shared = np.append(self.count, 0), np.append(shared, [False, True])
        before = np.concatenate([[self.begin], self.tokens[:-1]])
        before[self.starts] = self.begin
        # a bigram's key is (first, second)
        self.two, self.place2 = np.unique(before * self.m + self.tokens, return_inverse=True)
        self.own2 = np.bincount(self.place2[self.learn], minlength=len(self.two))
        self.asked2 = shared[self.two // self.m] & shared[self.two % self.m]

    def pairs(self) -> np.ndarray:
        return self.hashes[self.two // self.m] * STEP + self.hashes[self.two % self.m]

    def asks2(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the bigrams that others may hold, equal in all blocks, and own counts."""
        return mixed(self.pairs()[self.asked2] ^ TWO), self.own2[self.asked2]

    def learn2(self) -> None:
        """Takes the totals of bigrams, and lays out the trigrams."""
        self.count2, shared = self.own2.copy(), np.zeros(len(self.two), bool)
        at = np.flatnonzero(self.asked2)[np.argsort(self.asks2()[0])]
        self.count2[at], shared[at] = unpacked(self.told, 2)
        third = np.ones(len(self.tokens), bool)
        third[self.starts] = False
        third = np.flatnonzero(third)
        # a trigram's key is (place of its first two, third); its tail is the bigram that ends it
        self.three, first, place = np.unique(self.place2[third - 1] * self.m + self.tokens[third], return_index=True, return_inverse=True)
        self.tail = self.place2[third[first]]
        self.own3 = np.bincount(place[self.learn[third]], minlength=len(self.three))
        self.asked3 = shared[self.three // self.m] & shared[self.tail]

    def asks3(self) -> tuple[np.ndarray, np.ndarray]:
        asked = self.three[self.asked3]
        return mixed((self.pairs()[asked // self.m] * STEP + self.hashes[asked % self.m]) ^ THREE), self.own3[self.asked3]

    def learn3(self) -> None:
        self.count3 = self.own3.copy()
        at = np.flatnonzero(self.asked3)[np.argsort(self.asks3()[0])]
        self.count3[at], _ = unpacked(self.told, 3)


class Automaton:
    """What of the automaton a block can reach. States: words (by number), bigrams (m and their
    place), the root (last). Arcs are sorted by (state, word)."""

    def __init__(self, block: Block, totals: Totals):
        m, two, three = block.m, block.two, block.three
        c1 = np.append(block.count, totals.texts).astype(float)  # before a text stands one BEGIN
        c2, c3 = block.count2.astype(float), block.count3.astype(float)
        self.m, self.root = m, m + len(two)
        p1 = (c1[: m - 1] + 1) / totals.z
        p1 = np.append(p1, np.nan)  # nothing leads to BEGIN
        v, w = two // m, two % m
        p2 = (c2 + K2 * p1[w]) / (c1[v] + K2)
        b, x = three // m, three % m
        p3 = (c3 + K3 * p2[block.tail]) / (c2[b] + K3)
        seen2, seen3 = (c2 > 0) & (c1[v] > 0), c3 > 0
        self.keys = np.concatenate([two[seen2], m * m + three[seen3]])
        self.weights = np.log10(np.concatenate([p2[seen2], p3[seen3]]))
        self.targets = m + np.concatenate([np.flatnonzero(seen2), block.tail[seen3]])
        #: Failure arcs: a bigram's lead to its last word, a word's to the root.
        self.failure = np.concatenate([np.full(m, self.root), np.where(c1[w] > 0, w, self.root), [self.root]])
        self.failure_weights = np.log10(np.concatenate([K2 / (c1 + K2), K3 / (c2 + K3), [1.0]]))
        self.root_weights = np.log10(p1)
        self.root_targets = np.where(c1 > 0, np.arange(m), self.root)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New states and log-probabilities of one word each."""
        out, weight = np.empty(len(states), np.int64), np.zeros(len(states))
        todo = np.arange(len(states))
        while len(todo):
            at_root = states == self.root
            if at_root.any():
                done, w = todo[at_root], words[at_root]
                out[done], weight[done] = self.root_targets[w], weight[done] + self.root_weights[w]
                todo, states, words = todo[~at_root], states[~at_root], words[~at_root]
            if len(self.keys) and len(todo):
                key = states * self.m + words
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                done, at = todo[hit], at[hit]
                out[done], weight[done] = self.targets[at], weight[done] + self.weights[at]
                todo, states, words = todo[~hit], states[~hit], words[~hit]
            weight[todo] += self.failure_weights[states]
            states = self.failure[states]
        return out, weight

    def traverse(self, block: Block) -> np.ndarray:
        """Log-probability of each token. All lanes of the block go on together, each with its
        state."""
        lanes = -(-block.sizes // LANE)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = np.repeat(block.starts, lanes) + nth * LANE
        end = np.minimum(first + LANE, np.repeat(block.starts + block.sizes, lanes))
        lead = np.where(nth > 0, LEAD, 0)
        order = np.argsort(first - lead - end, kind="stable")  # the longest first
        first, end, lead = first[order], end[order], lead[order]
        at, length = first - lead, end - first + lead
        states = np.where(lead > 0, self.root, block.begin)
        out = np.zeros(len(block.tokens))
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k))  # lanes longer than k
            pos = at[:n] + k
            states, weight = self.step(states[:n], block.tokens[pos])
            own = lead[:n] <= k
            out[pos[own]] = weight[own]
        return out


def score(docs: DataFrame, learn: Column, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of docs: doc, `n_tokens`, `n_known` (tokens that training texts hold),
    `train_tokens`, `base_score` (log10 of p(w), summed) and `score` (the model's log10
    probability of the text). learn: which rows are training rows."""
    learned = F.coalesce(learn, F.lit(False)) & F.col(doc).isNotNull()
    source = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("t"), learned.alias("learn"))
    bits = max(6, math.ceil(math.log2(1 + 2 * input_bytes(docs, text) / block_bytes)))
    blocks = bucketed(blocked(source, block_bytes, bits), "home", "blocks")
    words = materialize(summed(blocks.where(F.col("kind") == ASKED).select("home", "block", "part", "keys", "counts")), "words")
    n, v = words.agg(F.sum("n"), F.sum("v")).first()
    totals = Totals(n or 0, v or 0, source.where("learn").count())
    rows = blocks.select("home", "block", "kind", "docs", "sizes", "learn", "tokens", "part", "keys").groupBy("home")
    levels = {1: words}

    def told() -> DataFrame:
        return union_all([x.select("home", "block", "part", "totals", F.lit(n).alias("level")) for n, x in levels.items()])

    def with_told(run: Callable[[Block], pa.Table], schema: str | T.StructType) -> DataFrame:
        """What run makes of each block, once it has been told."""

        def each(rows: pa.Table, told: pa.Table) -> pa.Table:
            names = np.unique(rows.column("block").to_numpy())
            return pa.concat_tables([run(Block(*(x.filter(pc.equal(x.column("block"), n)) for x in (rows, told)))) for n in names])

        return rows.cogroup(told().groupBy("home")).applyInArrow(each, schema)

    def ask2(block: Block) -> pa.Table:
        return asked_by(block, block.asks2())

    def ask3(block: Block) -> pa.Table:
        block.learn2()
        return asked_by(block, block.asks3())

    def asked_by(block: Block, asks: tuple[np.ndarray, np.ndarray]) -> pa.Table:
        keys, own = asks
        order = np.argsort(keys)
        return asked_table(packed(block.home, block.id, keys[order], own[order], bits))

    for level, ask in ((2, ask2), (3, ask3)):
        levels[level] = materialize(summed(with_told(ask, ASKED_SCHEMA)), f"grams{level}")
    schema = source.select("doc").schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def walk(block: Block) -> pa.Table:
        block.learn2()
        block.learn3()
        automaton = Automaton(block, totals)
        add = lambda x: np.add.reduceat(x, block.starts)
        known = add((block.tokens != block.unknown).astype(np.int64))
        columns = [block.sizes, known, np.full(len(known), totals.n), add(automaton.root_weights[block.tokens]), add(automaton.traverse(block))]
        return pa.table([block.docs, *[pa.array(c, k) for c, k in zip(columns, KINDS)]], schema.names)

    return with_told(walk, schema).withColumnRenamed("doc", doc)


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
