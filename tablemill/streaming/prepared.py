"""Commands and rules on streams.

Commands that look at one row, and rules that look at one row, hold no state, so they run on a
stream as they do on a table. Those that need the whole table (sorting, uniqueness, references)
are refused, except that rows can be deduplicated by key within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablemill.frame import FrameError, PreparedFrame
from tablemill.operators.commands import apply
from tablemill.operators.validate import DATASET_RULES, ValidationResult, validate

WHOLE_TABLE = ("sort", "deduplicate")


def apply_to_stream(frame: PreparedFrame, *commands: dict) -> PreparedFrame:
    for c in commands:
        if c["type"] in WHOLE_TABLE:
            raise FrameError(f"O comando {c['type']} precisa da tabela inteira.")
    return apply(frame, *commands)


def validate_stream(frame: PreparedFrame, rules: list[dict]) -> ValidationResult:
    """Issues as a stream; write them in append mode."""
    for r in rules:
        inner = [x["type"] for e in r.get("entries", []) for x in e["constraints"].values()]
        if r["type"] in DATASET_RULES or "unique" in inner or "compositeUnique" in inner:
            raise FrameError(f"A regra {r['type']} precisa da tabela inteira.")
    return validate(frame, rules)


def first_of_each(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """One row for each key within the watermark: the state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
