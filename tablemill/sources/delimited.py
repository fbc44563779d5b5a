"""Delimited text with provenance: every row knows its record number in the source.

The file is split by Spark, however large it is. A first pass counts lines, quotes and records of
each split (a few numbers for each); from them every split knows whether it starts inside a
quoted field and which record it starts with. The second pass parses records where they lie; only
the pieces of records that cross a split (two for each split) are shuffled. Parsed rows are
written to the shared folder once, so the types are then inferred from columns.

A source is a file, a folder or a pattern; several files are read in the order of their paths as
one, each with the same header, and their records are numbered on.

Defined cases: a blank record is counted but dropped; a short record's missing cells are null; a
record with more filled fields than the header, and a quote that is never closed, raise
SourceReadError; lines end with LF or CRLF; quotes stand around whole fields (doubled inside); a
file with a header alone gives no rows; an empty file raises EmptySource (among others it is left
out); files with unlike headers raise UnlikeHeaders.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ROW_NUM, ColumnInfo, PreparedFrame, make_column_id, slug
from tablemill.functions.parsing import csv_number
from tablemill.functions.storage import materialize

#: Delimiters looked for, in order of preference, and the size of the sample.
DELIMITERS, SAMPLE = (",", ";", "\t", "|"), 65_536
#: Forms of a header that are compared: with and without a byte order mark, quotes or a carriage
#: return; more than these are unlike.
MOST_HEADERS = 64
#: A zero-padded whole number is an id, not a number.
PADDED = r"^[-+]?0[0-9]+\z"


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    row: int | None = None


class SourceReadError(ValueError):
    def __init__(self, *issues: Issue):
        super().__init__("; ".join(i.message for i in issues))
        self.issues = issues


def detect_delimiter(sample: str) -> str:
    """The delimiter that stands most often outside quotes in the first line; a comma if none."""
    counts, inside = dict.fromkeys(DELIMITERS, 0), False
    for c in sample[:SAMPLE]:
        if c == '"':
            inside = not inside
        elif c in "\r\n" and not inside:
            break
        elif c in counts and not inside:
            counts[c] += 1
    return max(DELIMITERS, key=counts.__getitem__)


#: Fields may be as long as a task can hold.
csv.field_size_limit(2**31 - 1)


def fields_of(record: str, delimiter: str) -> list[str]:
    """A carriage return inside a line belongs to its field."""
    out: list[str] = []
    for row in csv.reader(io.StringIO(record.removesuffix("\r"), newline=""), delimiter=delimiter):
        out = [*out[:-1], f"{out[-1]}\r{row[0] if row else ''}", *row[1:]] if out else row
    return out or [""]


def source_ids(headers: list[str]) -> list[str]:
    """Slug and how often the same slug has stood so far."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        seen[slug(h)] = seen.get(slug(h), 0) + 1
        out.append(make_column_id(h, seen[slug(h)]))
    return out


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value and the split it stands in (file and start); a task reads a split's lines in order."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


Split = tuple[str, int]


def split_starts(lines: DataFrame) -> tuple[dict[Split, tuple[bool, int]], list[int], bool]:
    """For each split: whether it starts inside quotes, and the number of records begun before;
    then the number of each file's first record, and whether a quote stays open at a file's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # records that begin in the split if it starts outside quotes, or inside; quotes
        found: dict[Split, list[int]] = {}
        for batch in batches:
            for text, *split in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = found.setdefault(tuple(split), [0, 0, 0])
                s[s[2] % 2] += 1  # a line begins a record for the parity that is outside here
                s[2] += text.count('"')
        rows = [[*k, *v] for k, v in found.items()]
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "split", "outside", "inside", "quotes"])

    starts, heads, inside, begun, file = {}, [], False, 0, None
    for r in sorted(lines.mapInArrow(run, "file string, split long, outside long, inside long, quotes long").collect()):
        if r.file != file:
            if inside:
                break
            heads.append(begun + 1)
            file = r.file
        starts[r.file, r.split] = (inside, begun)
        begun += r.inside if inside else r.outside
        inside ^= r.quotes % 2 == 1
    return starts, heads, inside


PIECES = "num long, place long, text string, whole boolean"


def records_of(lines: DataFrame, starts: dict[Split, tuple[bool, int]]) -> DataFrame:
    """(num, text) of all records, numbered from 1."""
    shared = lines.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["num", "place", "text", "whole"]
        held: list[str] = []
        now, inside, num, torn, place = None, False, 0, False, 0
        for batch in batches:
            out: list[tuple] = []
            for text, *split in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if split != now:
                    if held:
                        out.append((num, place, "\n".join(held), False))
                    now, held, place = split, [], split[1]
                    inside, num = shared.value[tuple(split)]
                    torn = inside  # the first record began in an earlier split
                if not inside:
                    num += 1
                held.append(text)
                inside ^= text.count('"') % 2 == 1
                if not inside:
                    out.append((num, place, "\n".join(held), not torn))
                    held, torn = [], False
            yield batch_of(out, names)
        if held:
            yield batch_of([(num, place, "\n".join(held), False)], names)

    pieces = lines.mapInArrow(run, PIECES)
    joined = pieces.where("not whole").groupBy("num").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    return pieces.where("whole").select("num", "text").unionByName(joined.select("num", F.array_join(F.col("p.text"), "\n").alias("text")))


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def parsed(records: DataFrame, width: int, delimiter: str) -> DataFrame:
    """num, `cells` (as many as the header; null where a record is short) and `extra` (whether
    fields beyond are filled) of records with any filled field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, fields_of(t, delimiter)) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(n, f) for n, f in rows if any(f)]
            cells = [[*f[:width], *[None] * (width - len(f))] for _, f in rows]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array([any(f[width:]) for _, f in rows], pa.bool_())], ["num", "cells", "extra"])

    return records.mapInArrow(run, "num long, cells array<string>, extra boolean")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> PreparedFrame:
    lines = lines_of(spark, path)
    starts, heads, open_ = split_starts(lines)
    if not heads:
        raise SourceReadError(Issue("EmptySource", "O arquivo não possui cabeçalho."))
    if open_:
        raise SourceReadError(Issue("MissingQuotes", "Um campo entre aspas não foi fechado."))
    records = records_of(lines, starts)
    # one number for each file, as many as there are files
    first = F.broadcast(spark.createDataFrame([(n,) for n in heads], "num long"))
    kept = [r.text.removeprefix("﻿") for r in records.join(first, "num").groupBy("text").agg(F.min("num").alias("num")).orderBy("num").limit(MOST_HEADERS).collect()]
    delimiter = delimiter or detect_delimiter(kept[0])
    headers = fields_of(kept[0], delimiter)
    if any(fields_of(h, delimiter) != headers for h in kept):
        raise SourceReadError(Issue("UnlikeHeaders", "Os arquivos possuem cabeçalhos diferentes."))
    rows = materialize(parsed(records.join(first, "num", "left_anti"), len(headers), delimiter), "records")
    wrong = rows.where("extra").agg(F.min("num").alias("n")).first().n
    if wrong is not None:
        raise SourceReadError(Issue("TooManyFields", f"O registro {wrong} possui mais campos que o cabeçalho.", wrong))
    return typed(rows, headers, source_ids(headers))


def typed(rows: DataFrame, headers: list[str], ids: list[str]) -> PreparedFrame:
    """A column is of numbers if all its filled cells are and none is zero-padded; one scan
    tells for all columns."""
    cell = lambda i: F.try_element_at("cells", F.lit(i + 1))
    bad = [F.count_if((cell(i) != "") & (csv_number(cell(i)).isNull() | cell(i).rlike(PADDED))) for i in range(len(ids))]
    full = [F.count_if(cell(i) != "") for i in range(len(ids))]
    counts = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate([*bad, *full])]).first()
    number = [counts[i] == 0 and counts[i + len(ids)] > 0 for i in range(len(ids))]
    kinds = ["number" if n else "string" if counts[i + len(ids)] else "empty" for i, n in enumerate(number)]
    infos = tuple(ColumnInfo(c, h, i, k) for i, (c, h, k) in enumerate(zip(ids, headers, kinds)))
    columns = [(csv_number(cell(i)) if n else cell(i)).alias(c) for i, (c, n) in enumerate(zip(ids, number))]
    hidden = [F.concat(F.lit("row-"), F.col("num").cast("string")).alias(ROW_ID), F.col("num").alias(ROW_NUM), F.col("num").alias("_o0")]
    return PreparedFrame(rows.select(*columns, *hidden), infos, (("_o0", True),))
