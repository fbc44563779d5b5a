"""SentencePiece BPE encoding and decoding through a merge-type prefix table.

A BPE encoding has one property that makes a linear scan possible: every prefix of a text has
exactly one last token, and that token depends only on the last token of a shorter prefix. The
scan walks a text once; an Aho-Corasick automaton names the vocabulary pieces that end at each
position, a pair-compatibility test tells which of them BPE would really leave next to the
last token of the remaining prefix, and the table is then read backwards to recover the ids.
Decoding starts from the ids alone: pieces and byte pieces are joined and read as UTF-8.

The vocabulary is read on the driver, is bounded by the model (tens of thousands of pieces) and
is broadcast. Texts are processed where they lie: no shuffle, one pass, memory bounded by the
longest text.

Defined cases: null and empty texts give the begin and end ids only; null and empty ids decode
to '', as control ids and ids outside the vocabulary do; byte pieces that are no UTF-8 decode to
U+FFFD each and the unknown id to the library's mark for it; rows are independent, so repeated rows and ties give equal results; an empty table gives an empty table;
other columns of the input are carried only where named in `keep`.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: What the library writes for the unknown id.
UNKNOWN_MARK = " \u2047 "
#: Chunks up to this length are remembered, at most so many at a time.
CHUNK_CHARS, CHUNKS = 48, 400_000
#: Compatible and incompatible pairs remembered at most.
FITS = 1_000_000


def vocabulary(model: str) -> dict:
    """Pieces, scores and kinds of a SentencePiece BPE model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain, data, said = {}, {}, []
    for i in range(n):
        piece = sp.id_to_piece(i)
        said.append(b"" if sp.is_control(i) else UNKNOWN_MARK.encode() if sp.is_unknown(i) else piece.replace(SPACE, " ").encode())
        if sp.is_byte(i):
            data[int(piece[1:-1], 16)] = i
            said[i] = bytes([int(piece[1:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain[piece] = (i, sp.get_score(i))
    return {"pieces": plain, "bytes": data, "said": said, "unk": sp.unk_id(), "begin": sp.bos_id(), "end": sp.eos_id()}


def merged(text: str, score: dict[str, float]) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """BPE by definition, for short strings: merge the best pair, leftmost first. Also the
    parts that each merged string was made of."""
    parts, made = list(text), {}
    while len(parts) > 1:
        best = max(((score.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
        if best is None:
            break
        i = -best[1]
        made[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, made


class Packed(dict):
    """Ids of a piece as little-endian bytes; a character outside the vocabulary falls back to
    the ids of its UTF-8 bytes, or to the unknown id where the model has no byte pieces."""

    def __init__(self, vocab: dict):
        super().__init__((p, i.to_bytes(4, "little")) for p, (i, _) in vocab["pieces"].items())
        self.bytes, self.unk = vocab["bytes"], vocab["unk"]

    def __missing__(self, c: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ([self.bytes[b] for b in c.encode()] if self.bytes else [self.unk])])


class Chunks(dict):
    """Ids of chunks, worked out on first use; short ones are remembered."""

    def __init__(self, table: PrefixTable):
        self.table = table

    def __missing__(self, c: str) -> bytes:
        out = self.table.chunk(c)
        if len(c) <= CHUNK_CHARS:
            if len(self) >= CHUNKS:
                self.clear()
            self[c] = out
        return out


class Fits(dict):
    """For one piece, which pieces may follow it; worked out on first use."""

    def __init__(self, table: PrefixTable, piece: str):
        self.table, self.piece = table, piece

    def __missing__(self, other: str) -> bool:
        table = self.table
        table.known_fits += 1
        if table.known_fits > FITS:
            for x in table.after.values():
                x.clear()
            table.known_fits = 0
        self[other] = out = table.compatible(self.piece, other)
        return out


class PrefixTable:
    def __init__(self, vocab: dict):
        pieces = vocab["pieces"]
        #: Pieces of spaces alone share the lowest score and merge last, from the left.
        self.runs = {len(p): i for p, (i, _) in pieces.items() if set(p) == {SPACE}}
        lone = {p for p in pieces if len(p) > 1 and set(p) == {SPACE}}
        self.score = {p: s for p, (_, s) in pieces.items() if p not in lone}
        many = {p: s for p, s in self.score.items() if len(p) > 1}
        self.begin, self.end = (vocab[x].to_bytes(4, "little") for x in ("begin", "end"))
        self.packed = Packed(vocab)
        self.automaton = ahocorasick.Automaton()
        #: For each piece what stands at its right and left edge while it is being merged, from
        #: the whole piece to a character, with the score of the merge that ends it.
        self.right: dict[str, list] = {}
        self.left: dict[str, list] = {}
        for p in self.score:
            parts, made = merged(p, many)
            if len(parts) == 1:
                self.automaton.add_word(p, p)
                self.right[p] = self._edge(p, made, 1)
                self.left[p] = self._edge(p, made, 0)
        self.automaton.make_automaton()
        self.many = many
        self.after = {p: Fits(self, p) for p in self.right}
        self.known_fits = 0
        self.chunks = Chunks(self)
        self.longest = max(self.runs, default=1)
        self.split = self._cuts()

    def _cuts(self) -> re.Pattern | None:
        """Texts are cut where no piece can cross, so that chunks recur and can be remembered:
        before a space, at line ends, and between a letter and a mark that no piece joins."""
        if any(SPACE in p.lstrip(SPACE) for p in self.many):
            return None
        pairs = {p[i : i + 2] for p in self.many for i in range(len(p) - 1)}
        inner = {c for p in self.many for c in p}
        letter = re.compile("[^\\W\\d_]")
        marks = [m for m in ".,;:!?%*$#&|\"" if not any(x[1] == m and letter.match(x) for x in pairs)]
        line = "\n" if "\n" not in inner else ""
        whole = f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else "")
        if marks:
            whole = f"{SPACE}*[^\\W\\d_]++(?=[{re.escape(''.join(marks))}])|" + whole
        return re.compile(whole)

    def _edge(self, p: str, made: dict, side: int) -> list[tuple[str, float, float]]:
        """(string, score at which it was made, score at which it is used up)."""
        out, used = [], float("-inf")
        while True:
            out.append((p, self.score[p] if p in made else float("inf"), used))
            if p not in made:
                return out
            used, p = self.score[p], made[p][side]

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE of a + b leaves a and b side by side: no pair of what stands at the
        border at the same time may merge before the merge that uses either up. Equal scores
        are the same piece, where the left pair goes first."""
        many = self.many
        for x, x_made, x_used in self.right[a]:
            for y, y_made, y_used in self.left[b]:
                s = many.get(x + y)
                if s is not None and min(x_made, y_made) > max(x_used, y_used) and s > x_used and s >= y_used:
                    return False
        return True

    def pieces_of(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are marked; unknown characters stay single."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        after = self.after
        for end, p in self.automaton.iter(text):  # at each end the longest comes first
            end += 1
            if last[end] is None:
                prior = last[end - len(p)]
                if prior is None or after[prior][p]:  # None: the start, or an unknown character
                    last[end] = p
        out = []
        while n:
            p = last[n] or text[n - 1]
            out.append(p)
            n -= len(p)
        return out[::-1]

    def spaces(self, k: int) -> list[int]:
        """Ids of k spaces in a row: the leftmost pair that makes a piece merges first."""
        parts = [1] * k
        i = 0
        while i + 1 < len(parts):
            if parts[i] + parts[i + 1] in self.runs:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        return [self.runs[x] for x in parts]

    def chunk(self, text: str) -> bytes:
        """Little-endian ids of a chunk of a text."""
        pieces, packed = self.pieces_of(text), self.packed
        if pieces[:2] != [SPACE, SPACE]:
            return b"".join([packed[p] for p in pieces])
        k = 0
        while k < len(pieces) and pieces[k] == SPACE:
            k += 1
        # a run longer than the longest piece is dealt with in whole pieces first, in linear time
        longest = self.longest
        ids = [self.runs[longest]] * ((k // longest) - 1) if k > 2 * longest else []
        ids += self.spaces(k - longest * len(ids))
        return b"".join([i.to_bytes(4, "little") for i in ids] + [packed[p] for p in pieces[k:]])

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids with begin and end."""
        if not text:
            return self.begin + self.end
        marked = SPACE + text.replace(" ", SPACE)
        return self.begin + b"".join(map(self.chunks.__getitem__, self.split.findall(marked) if self.split else [marked])) + self.end


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("tablemill-each-byte", each_byte)


class Decoder:
    """The text of any ids."""

    def __init__(self, vocab: dict):
        self.said = vocab["said"]
        self.bytes = frozenset(vocab["bytes"].values())
        self.silent = np.array([not x for x in self.said])

    def text(self, ids: bytes | None) -> str:
        """Text of little-endian ids. The first piece that says anything loses one space in front,
        which encoding has put there."""
        numbers = np.frombuffer(ids or b"", "<u4")
        if numbers.max(initial=0) >= len(self.said):
            numbers = numbers[numbers < len(self.said)]
        parts = list(map(self.said.__getitem__, numbers.tolist()))
        for k, part in enumerate(parts):
            if part:
                if part[:1] == b" " and numbers[k] not in self.bytes and part != UNKNOWN_MARK.encode():
                    parts[k] = part[1:]
                break
        # byte pieces on both sides of a silent id are not one character
        edges = [0, *np.flatnonzero(self.silent[numbers]).tolist(), len(parts)]
        return "".join([b"".join(parts[a:b]).decode("utf-8", "tablemill-each-byte") for a, b in zip(edges, edges[1:]) if b > a])


_tables: dict[type, tuple[dict, PrefixTable | Decoder]] = {}


def table_of(make: type, shared) -> PrefixTable | Decoder:
    """A task's table; the worker keeps the last one of each type."""
    vocab = shared.value
    held = _tables.get(make)
    if held is None or held[0] is not vocab:
        _tables[make] = held = (vocab, make(vocab))
    return held[1]


def mapped(docs: DataFrame, vocab: dict, column: str, keep: tuple[str, ...], names: dict[str, str], steps: list[tuple[type, str]]) -> DataFrame:
    """keep columns and what the steps (a table and its method) make of the column, each of what the
    one before has made."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    source = docs.select(*[F.col(c) for c in keep], F.col(column).alias("__in"))
    schema = source.drop("__in").schema
    for name, kind in names.items():
        schema = schema.add(name, kind)
    kinds = [pa.binary() if kind == "binary" else pa.string() for kind in names.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [getattr(table_of(make, shared), method) for make, method in steps]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made, now = [], part.column(len(keep)).to_pylist()
                for step, kind in zip(each, kinds):
                    now = [step(x) for x in now]
                    made.append(pa.array(now, kind))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema.names)

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """keep columns and `ids` (binary, little-endian unsigned 32-bit integers, begin and end
    included) for every row of docs; with decode also `decoded`, the text of those ids, made from
    them in the same pass."""
    names = {"ids": "binary"} | ({"decoded": "string"} if decode else {})
    return mapped(docs, vocabulary(model), text, keep, names, [(PrefixTable, "encode"), (Decoder, "text")][: len(names)])


def decode(docs: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `decoded`, the text of the ids, for every row of docs."""
    return mapped(docs, vocabulary(model), ids, keep, {"decoded": "string"}, [(Decoder, "text")])
