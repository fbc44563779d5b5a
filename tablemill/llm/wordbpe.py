"""Byte-pair encoding by batched numpy merge rounds, and decoding.

A text is normalised and split into words as the vocabulary file says. The words of many texts that
have not been met lately lie, symbol by symbol, in one flat array; in each round the rank of every
neighbouring pair is found by binary search over the sorted pair keys, each word's lowest rank is
taken, and all words merge their pairs of that rank at once, from the left. Only pairs beside a
merge are looked up again, and words without a pair left leave the array. A pair of rank r is made
of symbols that lower ranks have made, so the pairs of one rank in a word never hinder each other
but where they overlap; `Merges.ordered` says whether the file keeps to that, and where it does not,
a round merges one pair for each word.

Texts are processed where they lie: no shuffle, one pass. A task holds the vocabulary (bounded by
the file, broadcast), up to CHUNKS recent words with their ids, and SLICE texts.

Characters from U+0300 on are rare in most corpora, and how they are composed, cased and classed
depends on the library's Unicode version. Stretches that hold any go through the library's own
normaliser and splitter; merges are always made here.

Defined cases: null and empty texts have no ids; null and empty ids decode to ''; ids outside the
vocabulary and null ids say nothing; strings of added tokens inside a text are those tokens, as in
the library; rows are independent, so repeated rows and ties give equal results; an empty table
gives an empty table; other columns of the input are carried only where named in `keep`.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Recent words kept by a task; texts worked on at once.
CHUNKS, SLICE = 400_000, 256
#: Stretches below this character take the short way.
PLAIN = 0x300
NONE = np.iinfo(np.int64).max


@dataclass
class Merges:
    """Sorted pair keys (left id, right id), and the rank and product of each."""

    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    #: Whether every product is made by one pair, and by one of a higher rank than its parts.
    ordered: bool

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair, NONE for those that never merge."""
        asked = left << 32 | right
        at = np.searchsorted(self.keys, asked)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == asked, self.ranks[at], NONE)


def merges_of(vocab: dict[str, int], pairs: list) -> Merges:
    pairs = [p.split(" ", 1) if isinstance(p, str) else p for p in pairs]
    if not pairs:
        return Merges(np.array([-1]), np.array([NONE]), np.array([-1]), True)
    left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in pairs)))
    keys = left << 32 | right
    # of a pair that is listed twice the last place counts
    last = {k: i for i, k in enumerate(keys.tolist())}
    ranks = np.array(sorted(last.values()), np.int64)
    born = {p: i for i, p in enumerate(made.tolist())}
    ordered = len(last) == len(pairs) == len(born) and all(born.get(x, -1) < i for i, both in enumerate(zip(left.tolist(), right.tolist())) for x in both)
    order = ranks[np.argsort(keys[ranks])]
    return Merges(keys[order], order, made, ordered)


def merge_rounds(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many words and their number for each word, from the words' first symbols (flat)
    and the number of those for each word (none is 0)."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    n = len(symbols)
    rank = np.full(n, NONE)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = merges.rank(symbols[inner], symbols[inner + 1])
    done_symbols, done_words = [], []
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.minimum.reduceat(rank, first)
        low = np.repeat(low, np.diff(np.append(first, len(symbols))))
        over = low == NONE
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            symbols, word, rank, low = (x[~over] for x in (symbols, word, rank, low))
        if not len(symbols):
            break
        hit = np.flatnonzero(rank == low)
        if merges.ordered:
            # of overlapping pairs (a a a) every second one merges
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - lead) % 2 == 0]
        else:
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
        symbols[hit] = merges.products[low[hit]]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        symbols, word, rank = symbols[stay], word[stay], rank[stay]
        at = hit - np.arange(len(hit))  # where the merged symbols stand now
        changed = np.concatenate([at, at[at > 0] - 1])
        rank[changed] = NONE
        changed = changed[changed + 1 < len(symbols)]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed] = merges.rank(symbols[changed], symbols[changed + 1])
    if not done_words:
        return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
    words = np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(words, minlength=len(sizes))


#: How the byte-level alphabet of vocabulary files writes bytes that are no printable characters.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> list[str]:
    """The character for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    other = [b for b in range(256) if b not in PRINTED]
    return [chr(b) if b in PRINTED else chr(0x100 + other.index(b)) for b in range(256)]


def vocabulary(path: str) -> dict:
    """What tasks need of a vocabulary file: tokens, merges, added tokens, and how texts are split."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec["pre_tokenizer"]
    steps = [x["type"] for x in splitter.get("pretokenizers", [splitter])]
    if model["type"] != "BPE" or steps != ["Split", "ByteLevel"] or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        raise ValueError("only byte-level BPE files with one split are understood")
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
        raise ValueError("added tokens must stand for their own strings alone")
    vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
    tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
    return {
        "said": [tokens.get(i) for i in range(max(tokens) + 1)],
        "inner": np.array([vocab[c] for c in letters], np.int64),
        "last": np.array([vocab[c + suffix] for c in letters], np.int64),
        "merges": merges_of(vocab, model["merges"]),
        "added": added,
        # the normaliser and the splitter alone
        "split": json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}),
    }


class Splitter:
    """Words of texts as bytes."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(spec)
        self.normal, self.words = whole.normalizer, whole.pre_tokenizer
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        classes = self._classes()
        #: Below PLAIN: how the file's pattern splits, in classes that the library itself gave.
        letters, numbers, spaces = ("".join(map(re.escape, classes[k])) for k in ("letter", "number", "space"))
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        self.findall = self.pattern.findall
        #: What the short way is not for: later characters, and those that split() and the file see differently.
        wrong = "".join(re.escape(c) for c in map(chr, range(PLAIN)) if c.isspace() != (c in classes["space"]) or ord(max(c.lower())) >= PLAIN)
        self.rare = re.compile(f"[{wrong}{chr(PLAIN)}-\U0010ffff]").search

    def _classes(self) -> dict[str, list[str]]:
        """Which of the characters below PLAIN, lower-cased, are letters, numbers and spaces of the pattern."""
        out: dict[str, list[str]] = {"letter": [], "number": [], "space": [], "mark": []}
        for c in map(chr, range(PLAIN)):
            if c.lower() != c:
                continue
            alone, after_letter, after_mark = (len(self.words.pre_tokenize_str(x + c)) for x in ("", "a", "#"))
            out["space" if not alone else "letter" if after_letter == 1 else "mark" if after_mark == 1 else "number"].append(c)
        return out

    def rare_words(self, text: str) -> list[bytes]:
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.words.pre_tokenize_str(self.normal.normalize_str(text))]


class Encoder:
    """Ids of texts, many at a time."""

    def __init__(self, vocab: dict):
        self.splitter = Splitter(vocab["split"])
        self.inner, self.last, self.merges, self.added = vocab["inner"], vocab["last"], vocab["merges"], vocab["added"]
        parts = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, parts)) + ")") if parts else None
        self.hint = parts and re.compile("|".join(sorted({re.escape(p[:2]) for p in parts}))).search
        self.known: dict[str | tuple, bytes] = {}

    def chunks(self, text: str | None) -> list[str | tuple]:
        """A text in chunks: between white space, or a stretch of rare characters or an added token
        as a tuple of its own."""
        if not text:
            return []
        if self.hint and self.hint(text) and self.cut.search(text):
            out: list[str | tuple] = []
            for k, part in enumerate(self.cut.split(text)):
                out += [(self.added[part],)] if k % 2 else self.chunks(part)
            return out
        return [("rare", text)] if self.splitter.rare(text) else text.lower().split()

    def learn(self, fresh: list[str | tuple]) -> None:
        """Works out the ids of chunks that are not known."""
        number = defaultdict(count().__next__)
        words, sizes = [], []
        for c in fresh:
            if isinstance(c, str):
                own = self.splitter.findall(c)
                words += [w.encode() for w in own]
            elif len(c) == 1:
                own = []
            else:
                own = self.splitter.rare_words(c[1])
                words += own
            sizes.append(len(own))
        which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids, n = self.encoded(list(number))
        # ids of all words in the chunks' order
        total = n[which]
        start = (np.cumsum(n) - n)[which]
        where = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total) + np.repeat(start, total)
        flat = ids[where].astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(total)])[np.cumsum(sizes)] * 4
        begin = 0
        for c, end in zip(fresh, ends.tolist()):
            self.known[c] = flat[begin:end] if isinstance(c, str) or len(c) == 2 else int(c[0]).to_bytes(4, "little")
            begin = end

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        return merge_rounds(symbols, sizes, self.merges)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        chunks = list(map(self.chunks, texts))
        fresh = set().union(*chunks).difference(self.known)
        if len(self.known) + len(fresh) > CHUNKS:
            self.known.clear()
            fresh = set().union(*chunks)
        if fresh:
            self.learn(list(fresh))
        out = [b"".join(map(self.known.__getitem__, c)) for c in chunks]
        for c in fresh:  # long ones don't come again
            if len(c) > 48 or isinstance(c, tuple):
                del self.known[c]
        return out


class Decoder:
    """The text of ids: their tokens joined by spaces, as a file without a decoder asks."""

    def __init__(self, vocab: dict):
        self.said = pa.array(vocab["said"], pa.string())

    def decode(self, ids: pa.Array) -> pa.Array:
        """ids: lists of 32-bit integers."""
        ids = ids.fill_null([]) if ids.null_count else ids
        flat, row = ids.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), np.asarray(ids.value_lengths()))
        good = np.isfinite(flat) & (flat >= 0) & (flat < len(self.said))
        if not good.all():
            flat, row = flat[good], row[good]
        tokens = self.said.take(pa.array(flat.astype(np.int64)))
        if tokens.null_count:
            row, tokens = row[np.asarray(tokens.is_valid())], tokens.drop_null()
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), " ")


_made: dict[type, tuple[dict, Encoder | Decoder]] = {}


def made(kind: type, shared: Broadcast) -> Encoder | Decoder:
    """A task's encoder or decoder; the worker keeps the last one of each."""
    held = _made.get(kind)
    if held is None or held[0] is not shared.value:
        _made[kind] = held = (shared.value, kind(shared.value))
    return held[1]


IDS = pa.list_(pa.int32())


def lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """keep columns and `ids` (array of integers) for every row of docs; with decode also `decoded`,
    the text of those ids, made from them in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = source.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("decoded", "string") if decode else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(Encoder, shared)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids = lists(encoder.encode(part.column(len(keep)).to_pylist()))
                more = [made(Decoder, shared).decode(ids)] if decode else []
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids, *more], schema.names)

    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `decoded`, the text of the ids, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").cast("array<int>").alias("__ids"))
    schema = source.drop("__ids").schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                got = made(Decoder, shared).decode(part.column(len(keep)).cast(IDS))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], got], schema.names)

    return source.mapInArrow(run, schema)
