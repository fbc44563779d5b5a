"""Pages of long results in their order.

The rows are sorted by range once and written, a folder for each range, with their place inside it. How many
rows each range has tells where any page lies: it reads only the folders of its own ranges, and of those the
row groups that hold its places.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.frame import PreparedFrame
from tablemill.functions.storage import new_path
from tablemill.operators.merge import preview
from tablemill.operators.validate import ISSUE, ValidationResult

PART, AT = "__part", "__at"


@dataclass(frozen=True)
class Pages:
    rows: DataFrame
    columns: tuple[str, ...]
    #: Numbers of the ranges that have rows, in order, and how many rows stand before each.
    parts: tuple[int, ...]
    before: tuple[int, ...]
    total: int
    size: int

    @property
    def count(self) -> int:
        return -(-self.total // self.size)

    def parts_of(self, page: int) -> list[tuple[int, int, int]]:
        """(range, first place, end place) of what a page, numbered from 0, holds."""
        start, end = page * self.size, min((page + 1) * self.size, self.total)
        out = []
        k = bisect_right(self.before, start) - 1
        while 0 <= start < end:
            low = self.before[k]
            high = self.before[k + 1] if k + 1 < len(self.before) else self.total
            out.append((self.parts[k], start - low, min(end, high) - low))
            start, k = min(end, high), k + 1
        return out

    def page(self, page: int) -> DataFrame:
        """The rows of a page in order; none beyond the last."""
        held = F.lit(False)
        for part, low, high in self.parts_of(page):
            held = held | ((F.col(PART) == part) & (F.col(AT) >= low) & (F.col(AT) < high))
        return self.rows.where(held).orderBy(PART, AT).select(*[F.col(f"`{c}`") for c in self.columns])


def paged(df: DataFrame, order: list[Column], size: int, columns: list[str] | None = None) -> Pages:
    """Pages of `size` rows of df in that order; as many numbers as there are ranges reach the driver."""
    kept = columns or df.columns
    spark, path = df.sparkSession, new_path(df.sparkSession, "pages")
    ranked = df.orderBy(*order).select(*[F.col(f"`{c}`") for c in kept], F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(AT))
    ranked.sortWithinPartitions(PART, AT).write.partitionBy(PART).parquet(path)
    schema = T.StructType([*ranked.schema.fields])
    rows = spark.read.schema(schema).parquet(path)
    counts = sorted((r[PART], r["n"]) for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for _, n in counts:
        before.append(total)
        total += n
    return Pages(rows, tuple(kept), tuple(p for p, _ in counts), tuple(before), total, size)


def frame_pages(frame: PreparedFrame, size: int) -> Pages:
    """A frame's rows in its order."""
    return paged(frame.df, frame.ordering, size, [*frame.ids, *frame.hidden[:2]])


def preview_pages(result: ValidationResult, view: str, size: int, rule: str | None = None, severity: str | None = None) -> Pages:
    """Pages of a preview (all, errors, valid) in the frame's order."""
    return frame_pages(result.frame.with_df(preview(result, view, rule, severity)), size)


def issue_pages(result: ValidationResult, size: int) -> Pages:
    """Pages of the issues in report order."""
    return paged(result.issues, result.report_order(), size, list(ISSUE))
