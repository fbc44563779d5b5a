"""Delimited text as a source of its own: spark.read and spark.readStream with format "delimited".

`register(spark)` makes it known. A file is read in splits of `splitBytes`, however large it is. The planner gives
each split what it cannot know by itself: whether it starts inside quotes, and how many records begin before
it. For that each split's bytes are looked at once (quotes and line ends are counted in constant memory): by the
planner, or, for inputs that are too much for one machine, by a Spark job (`plan_splits`), whose result is
handed on as the option `plan`.

A split owns the records that begin after its line ends, and reads on beyond its end until its last
one is whole. Columns are the header's, as text, with `_row_num`, the record's number; the defined cases are
those of `read_csv`. As a stream, a growing folder is read file by file in the order of time and name; the
offset is the last file and the number of records so far, so numbers go on.

Files are opened by pyarrow, so a path may name any file system that pyarrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tablemill.frame import ROW_NUM, PreparedFrame
from tablemill.functions.storage import materialize, new_path
from tablemill.sources.delimited import Issue, SourceReadError, detect_delimiter, fields_of, source_ids, typed

NAME = "delimited"
SPLIT_BYTES, CHUNK, BATCH = 32 << 20, 1 << 20, 10_000
QUOTE, LINE_END = ord('"'), ord("\n")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    #: Whether it starts inside quotes, and how many records begin before those that it owns.
    inside: bool
    before: int


@dataclass(frozen=True)
class File:
    path: str
    size: int
    #: Nanoseconds.
    time: int


def files_of(path: str) -> tuple[filesystems.FileSystem, list[File]]:
    """The file, or those of the folder that are not hidden, in the order of their paths."""
    system, place = filesystems.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (filesystems.LocalFileSystem(), path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(filesystems.FileSelector(place))
    kept = [x for x in found if x.is_file and not x.base_name.startswith(("_", "."))]
    return system, sorted((File(x.path, x.size, x.mtime_ns or 0) for x in kept), key=lambda f: f.path)


def line_ends(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of line ends outside and inside quotes, and the number of quotes."""
    quotes = np.cumsum(data == QUOTE)
    ends = np.flatnonzero(data == LINE_END)
    odd = (quotes[ends] + inside) % 2 == 1
    return ends[~odd], ends[odd], int(quotes[-1]) if len(quotes) else 0


def counted(system: filesystems.FileSystem, file: File, start: int, end: int) -> tuple[int, int, int]:
    """Of a range of bytes: records that begin after its line ends if it starts outside quotes, or inside, and quotes."""
    outside = inside = quotes = 0
    with system.open_input_file(file.path) as f:
        f.seek(start)
        at = start
        while at < end:
            data = np.frombuffer(f.read(min(CHUNK, end - at)), np.uint8)
            a, b, n = line_ends(data, bool(quotes % 2))
            # the last byte of a file ends a record but begins none
            a, b = (int((x + at + 1 < file.size).sum()) for x in (a, b))
            outside, inside, quotes, at = outside + a, inside + b, quotes + n, at + len(data)
    return outside, inside, quotes


def ranges(file: File, split_bytes: int) -> list[tuple[int, int]]:
    return [(s, min(s + split_bytes, file.size)) for s in range(0, file.size, split_bytes)]


def splits_of(counts: list[tuple[File, list[tuple[int, int, int, int, int]]]], before: int) -> tuple[list[Split], int]:
    """Splits of files, from (start, end, outside, inside, quotes) of each of their ranges, and the number of records
    after them."""
    out = []
    for file, parts in counts:
        inside, begun = False, before
        for start, end, a, b, quotes in parts:
            out.append(Split(file.path, start, end, inside, begun))
            begun += (start == 0) + (b if inside else a)
            inside ^= quotes % 2 == 1
        if inside:
            raise SourceReadError(Issue("MissingQuotes", "Um campo entre aspas não foi fechado."))
        before = begun
    return out, before


def counts_of(system: filesystems.FileSystem, files: list[File], split_bytes: int) -> list:
    return [(f, [(s, e, *counted(system, f, s, e)) for s, e in ranges(f, split_bytes)]) for f in files]


def plan_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """The splits of a path, counted by Spark tasks and written to the shared folder; the option `plan`."""
    _, files = files_of(path)
    rows = [(f.path, f.size, f.time, s, e) for f in files for s, e in ranges(f, split_bytes)]
    base = spark.createDataFrame(rows, "path string, size long, time long, start long, `end` long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = files_of(path)[0]
        for batch in batches:
            got = [counted(system, File(r["path"], r["size"], r["time"]), r["start"], r["end"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)]], [*batch.schema.names, "outside", "inside", "quotes"])

    found: dict[str, list] = {}
    for r in base.mapInArrow(run, base.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", outside long, inside long, quotes long").collect():
        found.setdefault(r.path, []).append((r.start, r.end, r.outside, r.inside, r.quotes))
    splits, _ = splits_of([(f, sorted(found.get(f.path, []))) for f in files], 0)
    place = new_path(spark, "plan")
    spark.createDataFrame([(json.dumps(asdict(s)),) for s in splits], "value string").coalesce(1).write.text(place)
    return place


def planned(place: str) -> list[Split]:
    system, files = files_of(place)
    lines = [x for f in files for x in system.open_input_stream(f.path).read().decode().splitlines()]
    return [Split(**json.loads(x)) for x in lines]


def records(system: filesystems.FileSystem, split: Split) -> Iterator[tuple[int, str]]:
    """(number, text) of the records that the split owns."""
    with system.open_input_file(split.path) as f:
        size = f.size()
        f.seek(split.start)
        data = f.read(split.end - split.start)
        outside, _, quotes = line_ends(np.frombuffer(data, np.uint8), split.inside)
        begins = [0] * (split.start == 0) + [int(x) + 1 for x in outside if split.start + x + 1 < size]
        if not begins:
            return
        # on to the end of the last record
        inside, more = split.inside ^ (quotes % 2 == 1), []
        while True:
            part = f.read(CHUNK)
            if not part:
                break
            ends, _, n = line_ends(np.frombuffer(part, np.uint8), inside)
            more.append(part[: ends[0]] if len(ends) else part)
            if len(ends):
                break
            inside ^= n % 2 == 1
    # a split that ends with a record's end owns the next one too
    whole = data + b"".join(more)
    for k, begin in enumerate(begins):
        end = begins[k + 1] - 1 if k + 1 < len(begins) else len(whole)
        text = whole[begin:end]
        yield split.before + k + 1, text.removesuffix(b"\n").decode("utf-8", "replace")


def header_of(system: filesystems.FileSystem, files: list[File]) -> str:
    for f in files:
        if f.size:
            for _, text in records(system, Split(f.path, 0, 1, False, 0)):
                return text.removeprefix("﻿")
    raise SourceReadError(Issue("EmptySource", "O arquivo não possui cabeçalho."))


class DelimitedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def head(self) -> tuple[list[str], str]:
        text = header_of(*files_of(self.options["path"]))
        delimiter = self.options.get("delimiter") or detect_delimiter(text)
        return fields_of(text, delimiter), delimiter

    def schema(self) -> T.StructType:
        columns = [T.StructField(c, T.StringType()) for c in source_ids(self.head()[0])]
        return T.StructType([*columns, T.StructField(ROW_NUM, T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DelimitedReader(self.options, *self.head())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return DelimitedStream(self.options, *self.head())


class Records:
    """What batches and streams share."""

    def __init__(self, options: dict, headers: list[str], delimiter: str):
        self.path, self.headers, self.delimiter = options["path"], headers, delimiter
        self.split_bytes = int(options.get("splitBytes") or SPLIT_BYTES)
        self.plan = options.get("plan")

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, width, held = files_of(self.path)[0], len(self.headers), []
        for number, text in records(system, split):
            if split.start == 0 and number == split.before + 1:
                if fields_of(text.removeprefix("﻿"), self.delimiter) != self.headers:
                    raise SourceReadError(Issue("UnlikeHeaders", "Os arquivos possuem cabeçalhos diferentes."))
                continue
            cells = fields_of(text, self.delimiter)
            if not any(cells):
                continue
            if any(cells[width:]):
                raise SourceReadError(Issue("TooManyFields", f"O registro {number} possui mais campos que o cabeçalho.", number))
            held.append([*cells[:width], *[None] * (width - len(cells)), number])
            if len(held) >= BATCH:
                yield self.batch(held)
                held = []
        if held:
            yield self.batch(held)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(self.headers))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.int64())], [*source_ids(self.headers), ROW_NUM])


class DelimitedReader(Records, DataSourceReader):
    def partitions(self) -> list[Split]:
        if self.plan:
            return planned(self.plan)
        return splits_of(counts_of(*files_of(self.path), self.split_bytes), 0)[0]


class DelimitedStream(Records, DataSourceStreamReader):
    def files(self, after: dict | None = None, until: dict | None = None) -> tuple[filesystems.FileSystem, list[File]]:
        system, found = files_of(self.path)
        low, high = ((x["time"], x["path"]) if x else None for x in (after, until))
        kept = [f for f in sorted(found, key=lambda f: (f.time, f.path)) if f.size and (low is None or (f.time, f.path) > low) and (high is None or (f.time, f.path) <= high)]
        return system, kept

    def initialOffset(self) -> dict:
        return {"time": -1, "path": "", "records": 0}

    def latestOffset(self) -> dict:
        known = self.__dict__.setdefault("known", {})
        system, found = self.files()
        for f in found:
            if f not in known:  # counted once
                known[f] = splits_of(counts_of(system, [f], self.split_bytes), 0)[1]
        last = found[-1] if found else File("", 0, -1)
        return {"time": last.time, "path": last.path, "records": sum(known[f] for f in found)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        system, found = self.files(start, end)
        return splits_of(counts_of(system, found, self.split_bytes), start["records"])[0]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DelimitedSource)


def frame_of(df: DataFrame, headers: list[str]) -> PreparedFrame:
    """What the source has read as a frame with types, as `read_csv` makes it."""
    ids = [c for c in df.columns if c != ROW_NUM]
    rows = materialize(df.select(F.col(ROW_NUM).alias("num"), F.array(*[F.col(f"`{c}`") for c in ids]).alias("cells")), "records")
    return typed(rows, headers, ids)
