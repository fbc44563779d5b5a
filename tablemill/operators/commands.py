"""The eighteen preparation commands: plain dictionaries, compiled to DataFrame plans.

Commands with `when` change only the rows where it holds. Nothing runs until the frame is
used; checks against the schema are made at once and raise FrameError or ConditionError.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ColumnInfo, FrameError, PreparedFrame, first_of_each, first_rows
from tablemill.functions.conditions import check_condition, condition, equal, expression, predicate, sure
from tablemill.functions.currency import currency_text
from tablemill.functions.parsing import converted_date, converted_number
from tablemill.functions.values import BOOLEAN, MIXED, NULL, NUMBER, STRING, Value, compared, unified
from tablemill.operators.schema import check_command

Command = Callable[[PreparedFrame, dict], PreparedFrame]
COMMANDS: dict[str, Command] = {}


def command(name: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return add


def apply(frame: PreparedFrame, *commands: dict) -> PreparedFrame:
    for c in commands:
        if c["type"] not in COMMANDS:
            raise FrameError(f"Comando desconhecido: {c['type']}")
        check_command(frame, c)
        frame = COMMANDS[c["type"]](frame, c)
    return frame


def guard(frame: PreparedFrame, cmd: dict, name: str = "when") -> Column | None:
    node = cmd.get(name)
    if node is None:
        return None
    check_condition(node, frame.value)
    return condition(node, frame.value, "transform")


def chosen(when: Column | None, new: Value, old: Value) -> tuple[str, Column]:
    """new where when holds, else old, in one kind."""
    if when is None:
        kind, (c,) = unified([new])
        return kind, c
    if new.kind == NULL and old.whole:
        return NUMBER, F.when(~when, old.column)
    kind, (a, b) = unified([new, old])
    return kind, F.when(when, a).otherwise(b)


def new_infos(frame: PreparedFrame, definitions: list[dict]) -> list[ColumnInfo]:
    ids = [d["id"] for d in definitions]
    for i in ids:
        if i in frame.ids or ids.count(i) > 1:
            raise FrameError(f"Coluna duplicada: {i}")
    first = max((c.source_index for c in frame.columns), default=-1) + 1
    return [ColumnInfo(d["id"], d["header"], first + k, d.get("detectedType") or "mixed") for k, d in enumerate(definitions)]


@command("reorderColumns")
def reorder_columns(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    infos = [frame.info(i) for i in cmd["columnIds"]]
    if sorted(cmd["columnIds"]) != sorted(frame.ids):
        raise FrameError("A nova ordem deve conter todas as colunas exatamente uma vez.")
    return frame.with_columns(infos)


@command("renameHeader")
def rename_header(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    frame.info(cmd["columnId"])
    return replace(frame, columns=tuple(replace(c, header=cmd["header"]) if c.id == cmd["columnId"] else c for c in frame.columns))


@command("sort")
def sort(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    """Stable: the order so far settles ties. Nulls come last in either direction."""
    new, order = {}, []
    for k, s in enumerate(cmd["sorts"]):
        v = frame.value(s["columnId"])
        name, up = f"_s{len(frame.order)}_{k}", s["direction"] == "asc"
        if v.kind == STRING:
            new[name] = F.collate(v.column, "UNICODE")
        elif v.kind == MIXED:  # numbers by size, all else by text; numbers against text by text
            new[name] = v.number
            new[name + "t"] = F.when(~v.is_null, F.collate(v.text, "UNICODE"))
        else:
            new[name] = v.column
        order += [(n, up) for n in new if n.startswith(name)]
    return replace(frame, df=frame.df.withColumns(new), order=(*order, *frame.order))


@command("filter")
def filter_rows(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    left, op = frame.value(cmd["columnId"]), cmd["operator"]
    right = Value.of(cmd.get("value"))
    if op == "equals":
        keep = equal(left, right, "transform") if "value" in cmd else F.lit(False)
    elif op == "contains":
        keep = F.contains(left.text, right.text)
    elif op in ("isEmpty", "notEmpty"):
        keep = predicate(left, op, right, "transform")
    elif op in ("greaterThan", "lessThan"):
        sign = compared(left, right)
        keep = sure(~left.is_null & ~right.is_null & (sign > 0 if op == "greaterThan" else sign < 0))
    else:
        raise FrameError(f"Operador de filtro desconhecido: {op}")
    return frame.with_df(frame.df.where(keep))


@command("removeEmptyRows")
def remove_empty_rows(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    ids = cmd["columnIds"] if cmd.get("columnIds") is not None else frame.ids
    keep = F.lit(False)
    for i in ids:
        keep = keep | ~sure(frame.value(i).empty("transform"))
    return frame.with_df(frame.df.where(keep))


@command("deduplicate")
def deduplicate(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    """Keeps the first or last row of each key; null is a key, and not the same as ''. Where the order has
    one direction, that is one aggregate over whole rows with partial results; else rows are only filtered
    by the ids that stay."""
    keys, last = {f"__k{k}": frame.value(i).key for k, i in enumerate(cmd["columnIds"])}, cmd["keep"] != "first"
    rows = frame.df.withColumns(keys) if keys else frame.df
    kept = first_of_each(frame, rows, list(keys), last)
    if kept is None:
        heads = first_rows(frame, rows, list(keys), last)
        kept = frame.df.join(heads.select(F.col(f"__o.{ROW_ID}").alias(ROW_ID)), ROW_ID, "left_semi")
    return frame.with_df(kept)


@command("splitColumn")
def split_column(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    v, when = frame.value(cmd["columnId"]), guard(frame, cmd)
    if not cmd["delimiter"] or not cmd["newColumns"]:
        raise FrameError("A divisão precisa de um delimitador e de novas colunas.")
    infos = new_infos(frame, cmd["newColumns"])
    parts = F.split(v.string, quoted(cmd["delimiter"]), -1)
    part = lambda k: F.nullif(F.try_element_at(parts, F.lit(k + 1)), F.lit(""))
    new = {c.id: part(k) if when is None else F.when(when, part(k)) for k, c in enumerate(infos)}
    at = frame.ids.index(cmd["columnId"]) + 1
    return frame.with_columns([*frame.columns[:at], *infos, *frame.columns[at:]], new)


def quoted(text: str) -> str:
    """A Java pattern for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


@command("combineColumns")
def combine_columns(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    texts, when = [frame.value(i).text for i in cmd["columnIds"]], guard(frame, cmd)
    (info,) = new_infos(frame, [cmd["newColumn"]])
    joined = F.nullif(F.array_join(F.filter(F.array(*texts), lambda x: x != ""), cmd["separator"]), F.lit(""))
    return frame.with_columns([*frame.columns, info], {info.id: joined if when is None else F.when(when, joined)})


@command("calculatedColumn")
def calculated_column(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    when = guard(frame, cmd)
    (info,) = new_infos(frame, [cmd["newColumn"]])
    _, (c,) = unified([expression(cmd["expression"], frame.value, "transform")])
    return frame.with_columns([*frame.columns, info], {info.id: c if when is None else F.when(when, c)})


@command("findReplace")
def find_replace(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    """An empty needle replaces empty cells; a number or boolean replaces equal cells; text is
    replaced inside strings, by default in any case. In the replacement $$ is $ and $& is what
    was found; references to what stands around it are refused."""
    find, new, when = cmd["find"], cmd["replace"], guard(frame, cmd)
    out = {}
    for i in cmd["columnIds"]:
        v = frame.value(i)
        if find is None or find == "":
            hit = sure(v.empty("transform"))
            out[i] = chosen(hit if when is None else hit & when, Value.of(new), v)[1]
        elif not isinstance(find, str):
            hit = sure(v.same(Value.of(find)))
            out[i] = chosen(hit if when is None else hit & when, Value.of(new), v)[1]
        elif v.kind in (STRING, MIXED):
            text = replaced_text(v.string, find, Value.of(new), bool(cmd.get("caseSensitive", False)))
            hit = v.string.isNotNull()
            out[i] = chosen(hit if when is None else hit & when, Value(STRING, text), v)[1]
    return frame.set(out) if out else frame


def replaced_text(c: Column, find: str, new: Value, case_sensitive: bool) -> Column:
    text = "" if new.literal is None else new.literal if isinstance(new.literal, str) else js_literal(new.literal)
    parts = re.split(r"(\$[$&`'])", text)
    if any(p in ("$`", "$'") for p in parts):
        raise FrameError("Referências ao texto ao redor não são aceitas na substituição.")
    if case_sensitive:
        return F.replace(c, F.lit(find), F.lit("".join("$" if p == "$$" else find if p == "$&" else p for p in parts)))
    java = "".join("\\$" if p == "$$" else "$0" if p == "$&" else p.replace("\\", "\\\\").replace("$", "\\$") for p in parts)
    return F.regexp_replace(c, F.lit("(?iu)" + quoted(find)), F.lit(java))


def js_literal(x: object) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(int(x)) if float(x).is_integer() else repr(float(x))


@command("dateConversion")
def date_conversion(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    v, when = frame.value(cmd["columnId"]), guard(frame, cmd)
    new = Value(STRING, converted_date(v.string, cmd["inputFormat"], cmd["outputFormat"]))
    return frame.set({cmd["columnId"]: chosen(when, new, v)[1]}, {cmd["columnId"]: "date"})


@command("numberConversion")
def number_conversion(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    v, when = frame.value(cmd["columnId"]), guard(frame, cmd)
    finite = F.when(~F.isnan(v.number) & (F.abs(v.number) != float("inf")), v.number)
    new = Value(NUMBER, F.coalesce(finite, converted_number(v.string, cmd["decimalSeparator"])))
    return frame.set({cmd["columnId"]: chosen(when, new, v)[1]}, {cmd["columnId"]: "number"})


@command("currencyConversion")
def currency_conversion(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    v, when = frame.value(cmd["columnId"]), guard(frame, cmd)
    new = Value(STRING, currency_text(v.number, cmd["locale"], cmd["currency"]))
    return frame.set({cmd["columnId"]: chosen(when, new, v)[1]}, {cmd["columnId"]: "string"})


def _affix(frame: PreparedFrame, cmd: dict, before: bool) -> PreparedFrame:
    v, when = frame.value(cmd["columnId"]), guard(frame, cmd)
    there = ~sure(v.empty("transform"))
    text = F.concat(F.lit(cmd["value"]), v.text) if before else F.concat(v.text, F.lit(cmd["value"]))
    return frame.set({cmd["columnId"]: chosen(there if when is None else there & when, Value(STRING, text), as_text_if_empty(v, when))[1]})


def as_text_if_empty(v: Value, when: Column | None) -> Value:
    """Without a condition only empty cells keep their value, so the column becomes text."""
    return v if when is not None else Value(STRING, v.string)


@command("prefix")
def prefix(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    return _affix(frame, cmd, True)


@command("suffix")
def suffix(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    return _affix(frame, cmd, False)


@command("fixedValue")
def fixed_value(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    v, when = frame.value(cmd["columnId"]), guard(frame, cmd)
    return frame.set({cmd["columnId"]: chosen(when, Value.of(cmd["value"]), v)[1]})


@command("conditionalRule")
def conditional_rule(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    when = guard(frame, cmd, "condition")
    return frame.set({u["columnId"]: chosen(when, Value.of(u["value"]), frame.value(u["columnId"]))[1] for u in cmd["updates"]})


@command("editCell")
def edit_cell(frame: PreparedFrame, cmd: dict) -> PreparedFrame:
    """A row id that no row has raises; looking it up is a job of its own."""
    return edit_cells(frame, [cmd])


def edit_cells(frame: PreparedFrame, edits: list[dict], check: bool = True) -> PreparedFrame:
    """Many edits in one pass, the last for a cell wins; edits are what a person typed, a list
    on the driver, and join the rows as a small table. check: raise for unknown row ids (one job)."""
    wanted = sorted({e["rowId"] for e in edits})
    if not wanted:
        return frame
    if check:
        asked = frame.df.sparkSession.createDataFrame([(i,) for i in wanted], f"{ROW_ID} string")
        unknown = F.broadcast(asked).join(frame.df.join(F.broadcast(asked), ROW_ID, "left_semi").select(ROW_ID), ROW_ID, "left_anti").agg(F.min(ROW_ID)).first()[0]
        if unknown is not None:
            raise FrameError(f"Linha desconhecida: {unknown}")
    for i in dict.fromkeys(e["columnId"] for e in edits):
        last = {e["rowId"]: e["value"] for e in edits if e["columnId"] == i}
        v = frame.value(i)
        kind, columns = unified([*map(Value.of, last.values()), v])
        c = columns[-1]
        if v.whole and kind == NUMBER and all(x is None or float(x).is_integer() for x in last.values()):
            c = v.column
        rows = F.array(*[F.struct(F.lit(row).alias(ROW_ID), new.alias("__new")) for row, new in zip(last, columns)])
        new = frame.df.sparkSession.range(1).select(F.inline(rows)).withColumn("__set", F.lit(True))
        frame = frame.with_df(frame.df.join(F.broadcast(new), ROW_ID, "left"))
        frame = frame.set({i: F.when(F.col("__set"), F.col("__new")).otherwise(c)})
        frame = frame.with_df(frame.df.drop("__new", "__set"))
    return frame


__all__ = ["BOOLEAN", "COMMANDS", "apply", "edit_cells"]
