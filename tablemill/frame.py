"""PreparedFrame: a DataFrame with column headers, row identity and an explicit row order."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.values import Value, kind_of

ROW_ID, ROW_NUM = "_row_id", "_row_num"
TYPES = {"number": "number", "string": "string", "boolean": "boolean", "mixed": "mixed", "null": "empty"}


class FrameError(ValueError):
    """A command or rule that does not fit the frame."""


def slug(header: str) -> str:
    bare = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", header)).lower()
    return re.sub("[^a-z0-9]+", "-", bare).strip("-") or "column"


def make_column_id(header: str, ordinal: int) -> str:
    return f"{slug(header)}__{ordinal}"


@dataclass(frozen=True)
class ColumnInfo:
    id: str
    header: str
    source_index: int
    detected_type: str = "mixed"


@dataclass(frozen=True)
class PreparedFrame:
    """df holds a column for each ColumnInfo (named by its id), ROW_ID, ROW_NUM and the hidden
    columns of `order`. Order columns are snapshots, so later edits don't move rows."""

    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    #: (hidden column, ascending); nulls come last either way.
    order: tuple[tuple[str, bool], ...]

    @property
    def ids(self) -> list[str]:
        return [c.id for c in self.columns]

    @property
    def hidden(self) -> list[str]:
        return [ROW_ID, ROW_NUM, *[name for name, _ in self.order]]

    @property
    def ordering(self) -> list[Column]:
        return [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in self.order]

    @property
    def reverse_ordering(self) -> list[Column]:
        return [F.col(n).desc_nulls_first() if up else F.col(n).asc_nulls_first() for n, up in self.order]

    def info(self, column_id: str) -> ColumnInfo:
        for c in self.columns:
            if c.id == column_id:
                return c
        raise FrameError(f"Coluna desconhecida: {column_id}")

    def value(self, column_id: str) -> Value:
        self.info(column_id)
        return Value.field(column_id, self.df.schema[column_id].dataType)

    def with_df(self, df: DataFrame) -> PreparedFrame:
        return replace(self, df=df)

    def with_columns(self, columns: list[ColumnInfo], new: dict[str, Column] | None = None) -> PreparedFrame:
        df = self.df.withColumns(new) if new else self.df
        ids = [c.id for c in columns]
        return replace(self, df=df.select(*[F.col(f"`{i}`") for i in ids], *self.hidden), columns=tuple(columns))

    def set(self, new: dict[str, Column], types: dict[str, str] | None = None) -> PreparedFrame:
        """Columns with new values; their detected types follow unless given."""
        df = self.df.withColumns(new)
        types = types or {}
        tag = lambda c: types.get(c.id) or TYPES[kind_of(df.schema[c.id].dataType)]
        return replace(self, df=df, columns=tuple(replace(c, detected_type=tag(c)) if c.id in new else c for c in self.columns))

    def to_dataframe(self, metadata: bool = True) -> DataFrame:
        """The visible columns, stamped with header, index and detected type."""
        stamp = lambda c: {"header": c.header, "sourceIndex": c.source_index, "detectedType": c.detected_type}
        return self.df.select(*[F.col(f"`{c.id}`").alias(c.id, **({"metadata": stamp(c)} if metadata else {})) for c in self.columns])

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.ordering)


#: Parts that the rows of one key are dealt in where only sorting tells the first.
PARTS = 64


def end_of(frame: PreparedFrame, last: bool = False) -> tuple[Column, bool] | None:
    """The order as one value, and whether the wanted row has the greatest; None if columns order in
    both directions. Nulls come last in either direction."""
    ways = {up for _, up in frame.order}
    if len(ways) != 1:
        return None
    up = ways.pop()
    parts = [x for n, _ in frame.order for x in ((F.col(n).isNull() if up else F.col(n).isNotNull()).alias(f"__null_{n}"), F.col(n))]
    return F.struct(*parts, F.col(ROW_ID).alias(ROW_ID)), up == last


def first_place(frame: PreparedFrame, last: bool = False) -> Column | None:
    """An aggregate with partial results in each task: order columns and ROW_ID of the first or last
    row. None if that takes sorting."""
    found = end_of(frame, last)
    return found and (F.max if found[1] else F.min)(found[0])


def first_of_each(frame: PreparedFrame, rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame | None:
    """Whole rows: the first or last of each key, by one aggregate with partial results (one shuffle, no
    join). None if that takes sorting."""
    found = end_of(frame, last)
    if found is None:
        return None
    kept = F.struct(*[F.col(f"`{c}`") for c in frame.df.columns])
    got = rows.groupBy(*keys).agg((F.max_by if found[1] else F.min_by)(kept, found[0]).alias("__row"))
    return got.where("__row IS NOT NULL").select("__row.*")


def first_rows(frame: PreparedFrame, rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """keys and `__o` (order columns and ROW_ID) of the first or last row of each key of rows, which
    have the frame's hidden columns. Each key's rows are sorted in PARTS parts, whose first rows are
    sorted again, so no key is sorted in one task."""
    names = [n for n, _ in frame.order]
    place = F.struct(*[F.col(n) for n in names], F.col(ROW_ID).alias(ROW_ID)).alias("__o")
    order = frame.reverse_ordering if last else frame.ordering
    rows = rows.select(*keys, *names, ROW_ID).withColumn("__part", F.pmod(F.xxhash64(ROW_ID), F.lit(PARTS)))
    for by in ([*keys, "__part"], keys or [F.lit(0)]):
        rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order, ROW_ID))).where("__at = 1")
    return rows.select(*keys, place)


#: What a key part holds of these is escaped in row ids; a null part is NULL_PART.
ESCAPE, BAR, NULL_PART = "\\", "|", "\\N"


def id_part(c: Column, kind: T.DataType) -> Column:
    text = c.cast("string")
    if not isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
        text = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(BAR), F.lit(ESCAPE + BAR))
    return F.coalesce(text, F.lit(NULL_PART))


def require_unique_ids(frame: PreparedFrame) -> PreparedFrame:
    """The frame, after one job that raises if two of its rows share an id."""
    twice = frame.df.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min(ROW_ID)).first()[0]
    if twice is not None:
        raise FrameError(f"Identificador de linha duplicado: {twice}")
    return frame


def from_dataframe(df: DataFrame, key: list[str], columns: list[str] | None = None, prefix: str = "row-") -> PreparedFrame:
    """A frame over any DataFrame; key is a unique key that gives rows their order and their id: its parts
    joined by |, with backslashes before those and backslashes inside texts, and \\N for null, so
    that unlike keys have unlike ids."""
    if not key:
        raise FrameError("Uma ordem explícita de linhas é obrigatória.")
    kept = columns or df.columns
    schema = df.schema
    infos = [ColumnInfo(c, c, i, TYPES[kind_of(schema[c].dataType)]) for i, c in enumerate(kept)]
    order = {f"_o{i}": F.col(f"`{k}`") for i, k in enumerate(key)}
    row_id = F.concat(F.lit(prefix), F.concat_ws(BAR, *[id_part(F.col(f"`{k}`"), schema[k].dataType) for k in key]))
    hidden = {**order, ROW_ID: row_id, ROW_NUM: F.lit(None).cast("long")}
    if len(key) == 1 and schema[key[0]].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint"):
        hidden[ROW_NUM] = F.col(f"`{key[0]}`").cast("long")
    frame = df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in hidden.items()])
    return PreparedFrame(frame, tuple(infos), tuple((n, True) for n in order))
