"""Looking at values before preparing them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.frame import PreparedFrame, first_place, first_rows
from tablemill.functions.conditions import sure
from tablemill.functions.normalized import normalize_text, normalized
from tablemill.functions.parsing import DATE_FORMATS
from tablemill.functions.values import MIXED, Value

#: Fixed values, in order of preference.
DELIMITERS = (" ", ",", ";", "|", "-", "/", "\t")
DISTINCT = 500


def place(frame: PreparedFrame):
    return F.struct(*[F.col(n) for n, _ in frame.order])


def distinct_values(frame: PreparedFrame, column_id: str, limit: int = DISTINCT) -> DataFrame:
    """The first `limit` distinct values in order of appearance, with their `place`; null and '' are one, null.

    Each task keeps the first `limit` of its own values alone: one of the first of all is among the first
    of the task where it first stands. So at most that many rows of each task are shuffled, however many
    values there are. Mixed values, and orders by text, are found by an aggregate over all values."""
    v = frame.value(column_id)
    rows = frame.df.select(F.when(~sure(v.empty("transform")), v.column).alias("value"), *[F.col(n) for n in frame.hidden])
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    if v.kind != MIXED and all(isinstance(rows.schema[n].dataType, plain) for n, _ in frame.order):
        rows = rows.mapInArrow(first_values(frame.order, rows.schema, limit), rows.schema)
    heads = frame.with_df(rows)
    if first_place(heads) is not None:
        found = rows.groupBy("value").agg(first_place(heads).alias("__o"))
    else:
        found = first_rows(heads, rows, ["value"])
    first = found.select("value", *[F.col(f"__o.{n}").alias(n) for n, _ in frame.order])
    return first.orderBy(*frame.ordering).limit(limit).select("value", place(frame).alias("place"))


def first_values(order: tuple[tuple[str, bool], ...], schema: T.StructType, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task that keeps its first `limit` distinct values."""
    broken = [n for n, _ in order if isinstance(schema[n].dataType, (T.DoubleType, T.FloatType))]

    def ranked(table: pa.Table) -> pa.Table:
        keys = []
        for name, up in order:
            way = "ascending" if up else "descending"
            if name in broken:  # NaN is the greatest number
                table = table.append_column(f"__nan_{name}", pc.is_nan(table[name]))
                keys.append((f"__nan_{name}", way))
            keys.append((name, way))
        return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end")).select(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            table = ranked(table)
            codes = table["value"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            kept = table.take(np.sort(np.unique(codes, return_index=True)[1])[:limit])
        yield from kept.combine_chunks().to_batches() if kept is not None else []

    return run


def delimiter_counts(frame: PreparedFrame, column_id: str) -> DataFrame:
    """delimiter and occurrences of those that occur in string cells, most first, one scan."""
    s = frame.value(column_id).string
    n = [F.sum(F.length(s) - F.length(F.replace(s, F.lit(d), F.lit("")))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]
    pairs = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.coalesce(f"d{i}", F.lit(0)).cast("long").alias("occurrences"), F.lit(i).alias("place")) for i, d in enumerate(DELIMITERS)])
    return frame.df.agg(*n).select(F.inline(pairs)).where("occurrences > 0").orderBy(F.desc("occurrences"), "place").drop("place")


def date_formats(frame: PreparedFrame, column_id: str) -> DataFrame:
    """Formats of string cells, by first appearance."""
    s = F.trim(frame.value(column_id).string)
    form = F.lit(None).cast("string")
    for name, shape in DATE_FORMATS.items():
        form = F.when(s.rlike(shape), name).otherwise(form)
    rows = frame.df.select(form.alias("format"), place(frame).alias("o")).where("format is not null")
    return rows.groupBy("format").agg(F.min("o").alias("place")).orderBy("place")


def decimal_separator(frame: PreparedFrame, column_id: str) -> DataFrame:
    """One row: the separator that ends more numbers (ties: the dot), and both counts."""
    s = frame.value(column_id).string
    counts = frame.df.agg(F.count_if(s.rlike(r",[0-9]+\z")).alias("commas"), F.count_if(s.rlike(r"\.[0-9]+\z")).alias("dots"))
    return counts.select(F.when(F.col("commas") > F.col("dots"), ",").otherwise(".").alias("separator"), "commas", "dots")


def display(v: Value):
    return F.when(sure(v.empty("transform")), "Vazio").otherwise(v.text)


def parse_cell_input(text: str, kind: str) -> object:
    """What a person typed for a column of that kind: blank is null; numbers take a comma; bad
    numbers and booleans raise TypeError."""
    bare = text.strip()
    if not bare:
        return None
    if kind == "number":
        t = bare.replace(".", "").replace(",", ".", 1) if "," in bare else bare
        try:
            x = float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else math.nan
        except ValueError:
            x = math.nan
        if not math.isfinite(x):
            raise TypeError(f"Número inválido: {text}")
        return x
    if kind == "boolean":
        if bare.lower() not in ("true", "false"):
            raise TypeError(f"Booleano inválido: {text}")
        return bare.lower() == "true"
    return text


def edited_value(text: str, old: object) -> object:
    """What a person typed over a cell: a number or boolean stays one if the text says one (a comma
    is a point), else the text itself."""
    if isinstance(old, bool):
        return {"true": True, "false": False}.get(text, text)
    if isinstance(old, (int, float)):
        bare = text.replace(",", ".", 1).strip()
        return float(bare) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", bare) and math.isfinite(float(bare)) else text
    return text


def search(frame: PreparedFrame, column_id: str, query: str) -> PreparedFrame:
    """Rows whose text holds the query, whatever the case, accents and marks between words."""
    return frame.with_df(frame.df.where(F.contains(normalized(frame.value(column_id).text), F.lit(normalize_text(query)))))


def memory_risk(df: DataFrame, threshold: int) -> tuple[int, str]:
    """Bytes by Spark's statistics, and safe, warning or high against a threshold."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n, "safe" if n <= threshold else "warning" if n < 2 * threshold else "high"
