"""Decision tables as data.

The entries of a conditional matrix are rows of small tables, not expressions: one table for each mask,
the way in which an entry's keys are given (a value, null, empty, any). A row of the checked data looks its
entries up by one typed hash join for each mask that occurs, gets their constraints as an array and
takes that apart; a constraint's bounds and lists are columns of the table. The plan grows with the
masks and with the kinds of constraints by column, never with the entries.

The tables are made of the rule, so they are as large as the rule; whether a join broadcasts them is left to
Spark's size check. Only entries without any value among their keys (one row for each such mask) are
broadcast always.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.frame import PreparedFrame
from tablemill.functions.conditions import condition, sure
from tablemill.functions.values import BOOLEAN, CELL, MIXED, NULL, NUMBER, STRING, Value
from tablemill.operators.checks import Params, failure, parts_of
from tablemill.operators.rules import MESSAGES, java_pattern, number_label

#: How a key is given.
VALUE, IS_NULL, EMPTY, ANY = "value", "null", "empty", "any"
SKIPPED = ("any", "unique", "compositeUnique")
CONSTRAINT = T.StructType().add("part", "long").add("dependent", "integer").add("check", "string").add("code", "string").add("message", "string").add("cell", CELL)
CONSTRAINT = CONSTRAINT.add("number", "double").add("text", "string").add("numbers", T.ArrayType(T.DoubleType())).add("strings", T.ArrayType(T.StringType())).add("booleans", T.ArrayType(T.BooleanType()))
#: What no text matches.
NEVER = "(?!)"


def cell_of(x: object) -> tuple | None:
    """A literal as CELL."""
    if x is None:
        return None
    if isinstance(x, bool):
        return (BOOLEAN, None, None, x)
    return (NUMBER, float(x), None, None) if isinstance(x, (int, float)) else (STRING, None, str(x), None)


def constraint_rows(rule: dict, place: int, entry: dict) -> list[tuple]:
    """One row of CONSTRAINT for each check of an entry."""
    out, width = [], len(rule["dependentColumnIds"])
    for d, c in enumerate(rule["dependentColumnIds"]):
        x = entry["constraints"].get(c)
        if not x or x["type"] in SKIPPED:
            continue
        own = x["type"] in ("required", "empty", "equals")
        for k, (check, code, arg) in enumerate([("equals", "equals", None)] if x["type"] == "equals" else parts_of(x)):
            text = MESSAGES[f"conditional_{code}"] if own else "Regra condicional: " + MESSAGES[code].format(number_label(arg))
            lists = x.get("allowedValues" if check == "allowed" else "disallowedValues") or [] if check in ("allowed", "not_allowed") else []
            numbers = [float(v) for v in lists if isinstance(v, (int, float)) and not isinstance(v, bool)]
            said = x.get("pattern") or x.get("prefix") or x.get("suffix") if check.startswith("format") else arg if isinstance(arg, str) else None
            if check == "format regex" and not java_pattern(said or ""):
                said = NEVER
            size = float(arg) if isinstance(arg, (int, float)) else None
            part = 1 + (place * width + d) * 2 + k
            out.append((part, d, check, f"conditional_{code}", text, cell_of(x.get("value")), size, said, numbers, [v for v in lists if isinstance(v, str)], [v for v in lists if isinstance(v, bool)]))
    return out


def state(node: dict) -> str:
    if node["operator"] == "equals":
        return IS_NULL if node["value"] is None else VALUE
    return {"empty": EMPTY, "any": ANY}[node["operator"]]


def typed_key(kind: str, x: object) -> object:
    """What a column of that kind holds where it equals x; None if it cannot."""
    cell = cell_of(x)
    if kind == MIXED:
        return cell
    return next((v for v in cell[1:] if v is not None), None) if cell[0] == kind else None


KEY_TYPES = {NUMBER: T.DoubleType(), STRING: T.StringType(), BOOLEAN: T.BooleanType(), MIXED: CELL}


def tables(frame: PreparedFrame, rule: dict, payload: T.DataType, entries: Iterable[tuple[dict, list]]) -> dict[tuple[str, ...], DataFrame]:
    """For each mask the table of its keys (`k0`, `k1`, ... of those given as values) with the payloads of
    all entries that have them, as `load`. Entries that no row can meet are left out."""
    ids = rule["keyColumnIds"]
    kinds = [frame.value(c).kind for c in ids]
    rows: dict[tuple[str, ...], dict[tuple, list]] = {}
    for entry, load in entries:
        nodes = [entry["conditions"].get(c) for c in ids]
        if any(n is None for n in nodes):
            continue
        mask = tuple(map(state, nodes))
        key = tuple(typed_key(k, n["value"]) if k != NULL else None for k, n, s in zip(kinds, nodes, mask) if s == VALUE)
        if None not in key:
            rows.setdefault(mask, {}).setdefault(key, []).extend(load)
    spark, out = frame.df.sparkSession, {}
    for mask, found in rows.items():
        schema = T.StructType([T.StructField(f"k{i}", KEY_TYPES[k]) for i, (k, s) in enumerate(zip(kinds, mask)) if s == VALUE])
        schema.add("load", T.ArrayType(payload))
        out[mask] = spark.createDataFrame([(*key, load) for key, load in found.items()], schema)
    return out


def looked_up(frame: PreparedFrame, rows: DataFrame, rule: dict, payload: T.DataType, entries: Iterable[tuple[dict, list]]) -> DataFrame:
    """rows (of the frame) with `__hit`, whether they meet an entry, and `__load`, the payloads of all
    that they meet."""
    ids, loads = rule["keyColumnIds"], []
    for n, (mask, table) in enumerate(tables(frame, rule, payload, entries).items()):
        fits = []
        for i, (c, s) in enumerate(zip(ids, mask)):
            v = frame.value(c)
            if s == VALUE:
                here = v.number if v.kind == NUMBER else v.column
                fits.append(here == F.col(f"__k{n}_{i}"))
            elif s != ANY:
                fits.append(sure(v.empty("validate") if s == EMPTY else v.is_null))
        named = table.select(*[F.col(c).alias(f"__{'k' + str(n) + '_' + c[1:] if c != 'load' else 'load' + str(n)}") for c in table.columns])
        on = reduce(lambda a, b: a & b, fits, F.lit(True))
        rows = rows.join(named if VALUE in mask else F.broadcast(named), on, "left").drop(*[c for c in named.columns if c.startswith("__k")])
        loads.append(f"__load{n}")
    none = F.lit(None).cast(T.ArrayType(payload))
    found = [F.coalesce(F.col(x), F.array().cast(T.ArrayType(payload))) for x in loads]
    hit = reduce(lambda a, b: a | b, [F.col(x).isNotNull() for x in loads], F.lit(False))
    return rows.withColumns({"__hit": hit, "__load": F.concat(*found) if found else none}).drop(*loads)


def matches(frame: PreparedFrame, rule: dict) -> DataFrame:
    """Rows of the frame that meet some entry."""
    return looked_up(frame, frame.df, rule, T.IntegerType(), [(e, []) for e in rule["entries"]]).where("__hit").drop("__hit", "__load")


class FromTable(Params):
    """A check's bounds and lists, from the constraint `__x` that the row has looked up."""

    def number(self, name: str) -> Column:
        return F.col("__x.number")

    def text(self, name: str) -> Column:
        return F.col("__x.text")

    def listed(self, v: Value, name: str) -> Column:
        has = {NUMBER: ("numbers", v.number), STRING: ("strings", v.string), BOOLEAN: ("booleans", v.boolean)}
        kinds = has if v.kind == MIXED else [v.kind] if v.kind in has else []
        return reduce(lambda a, b: a | b, [sure(F.array_contains(F.col(f"__x.{has[k][0]}"), has[k][1])) for k in kinds], F.lit(False))


def entry_issues(frame: PreparedFrame, rule: dict, said: Callable[[str], tuple[Column, Column]]) -> DataFrame:
    """Hidden columns of the frame, `part`, `columnId`, `code`, `message`, `severity`, `value` and `valueType`: a
    row for each constraint that a row breaks, and for each row that meets no entry (part 0). said: a column's
    text and kind."""
    ids, dependents = rule["keyColumnIds"], rule["dependentColumnIds"]
    loads = [(e, constraint_rows(rule, i, e)) for i, e in enumerate(rule["entries"])]
    combos = sorted({(x[1], x[2]) for _, load in loads for x in load})
    # no column beside the keys, the dependents and the frame's own goes through the joins
    used = frame.df.where(condition(rule.get("when"), frame.value, "validate")).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*ids, *dependents])], *frame.hidden)
    rows = looked_up(frame, used, rule, CONSTRAINT, loads)
    behavior, first = rule.get("noMatchBehavior"), [*ids, *dependents, ""][0]
    load = F.col("__load")
    if behavior != "ignore":
        none = F.struct(F.lit(0).cast("long").alias("part"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in CONSTRAINT.fields[1:]])
        load = F.when(F.col("__hit"), load).otherwise(F.array(none))
    rows = rows.select(*[c for c in rows.columns if c not in ("__hit", "__load")], F.explode(load).alias("__x"))
    broken = F.col("__x.part") == 0
    value, tag = said(first)
    for d, check in combos:
        v = frame.value(dependents[d])
        fails = ~sure(v.same(Value(MIXED, F.col("__x.cell")))) if check == "equals" else failure(v, check, FromTable())
        broken = F.when((F.col("__x.dependent") == d) & (F.col("__x.check") == check), sure(fails)).otherwise(broken)
    rows = rows.where(broken)
    for d in sorted({d for d, _ in combos}):
        text, kind = said(dependents[d])
        value, tag = (F.when(F.col("__x.dependent") == d, a).otherwise(b) for a, b in ((text, value), (kind, tag)))
    alone, unmet = F.col("__x.part") == 0, "error" if behavior == "error" else "warning"
    either = lambda here, other: F.when(alone, F.lit(here)).otherwise(other)
    column = either(first, F.element_at(F.array(*map(F.lit, [*dependents, ""])), F.col("__x.dependent") + 1))
    fields = {
        "part": F.col("__x.part"), "columnId": column, "code": either("conditional_no_match", F.col("__x.code")),
        "message": F.lit(rule["message"]) if rule.get("message") else either(MESSAGES["conditional_no_match"], F.col("__x.message")),
        "severity": F.lit(rule["severity"]) if rule.get("severity") else either(unmet, F.lit("warning")),
        "value": value, "valueType": tag,
    }
    return rows.select(*frame.hidden, *[v.alias(k) for k, v in fields.items()])


def unique_contexts(rule: dict) -> dict[tuple[str, ...], list[tuple[dict, int]]]:
    """Entries that ask for unique values, and their parts, by the columns that have to be."""
    out: dict[tuple[str, ...], list[tuple[dict, int]]] = {}
    width = len(rule["dependentColumnIds"])
    for e, entry in enumerate(rule["entries"]):
        for d, c in enumerate(rule["dependentColumnIds"]):
            x = entry["constraints"].get(c) or {"type": "any"}
            ids = (c,) if x["type"] == "unique" else tuple(x["columnIds"]) if x["type"] == "compositeUnique" else ()
            if ids:
                out.setdefault((x["type"], *ids), []).append((entry, e * width + d))
    return out


def in_contexts(frame: PreparedFrame, rule: dict, entries: list[tuple[dict, int]]) -> DataFrame:
    """The frame's rows once for each of the entries that they meet, with its part as `__part`."""
    rows = looked_up(frame, frame.df, rule, T.LongType(), [(e, [part]) for e, part in entries])
    return rows.where("__hit").select(*frame.df.columns, F.explode("__load").alias("__part"))
