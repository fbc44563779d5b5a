"""Rules over data: an issues DataFrame, and what it says about each rule.

All rules that look at one row are compiled into flags of one scan, however many they are. Rules over the whole dataset count their keys first (with partial counts in each
task) and join the few keys that fail back to the rows, so a key with a third of all rows is
never gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ROW_NUM, PreparedFrame, first_place, first_rows
from tablemill.functions.conditions import condition, expression, ordered_numbers, sure
from tablemill.functions.values import MIXED, NUMBER, Value
from tablemill.operators import matrix
from tablemill.operators.checks import Params, failure, parts_of
from tablemill.operators.progress import Operation
from tablemill.operators.rules import MESSAGES, RELATION_MESSAGES, RELATION_OTHER, configuration_errors, number_label, referenced_columns, rule_id

ISSUE = ("rowId", "sourceRowNumber", "columnId", "code", "value", "valueType", "message", "severity", "ruleId")
#: Where an issue stands: row-local ones first, then by rule, group and part of the rule.
PLACE = ("phase", "ruleIndex", "part", "groupFirst")
DATASET_RULES = ("unique", "compositeUnique", "reference", "relation")


@dataclass
class Check:
    """A failure that a row can have."""

    fails: Column
    column_id: str
    code: str
    message: str
    severity: str = "error"


@dataclass
class ValidationResult:
    frame: PreparedFrame
    rules: list[dict]
    issues: DataFrame
    configuration_errors: list[dict]
    order: list[Column] = field(default_factory=list)
    #: Index, id and rule of those that look at one row.
    local: list[tuple[int, str, dict]] = field(default_factory=list)

    def ordered(self) -> DataFrame:
        """Issues in report order: row-local ones by row, then rule by rule."""
        return self.issues.orderBy(*self.report_order()).select(*ISSUE)

    def report_order(self) -> list[Column]:
        by_rule = [F.when(F.col("phase") == 1, F.col(c)) for c in ("ruleIndex", "part")]
        return [F.col("phase"), *by_rule, *self.group_order(), *self.order, F.col("ruleIndex"), F.col("part")]

    def group_order(self) -> list[Column]:
        """By the first row of a group, in the frame's order."""
        first = lambda n: F.col("groupFirst")[n]
        return [first(n).asc_nulls_last() if up else first(n).desc_nulls_last() for n, up in self.frame.order]

    def is_valid(self) -> bool:
        return not self.configuration_errors and self.issues.where("severity = 'error'").limit(1).isEmpty()

    def impact(self) -> DataFrame:
        """ruleId, affectedRows and affectedCells for every rule, also for those without issues. Rules that look at
        one row are counted in one aggregate over the rows; only the others' issues are grouped."""
        spark = self.issues.sparkSession
        names = list(dict.fromkeys(rule_id(r, i) for i, r in enumerate(self.rules)))
        local = {name for _, name, _ in self.local}
        other = {rule_id(r, i) for i, r in enumerate(self.rules) if r["type"] in (*DATASET_RULES, "conditionalMatrix")}
        counted = sorted(local - other)
        parts = [self.counted(counted)] if counted else []
        if other or not counted:
            rows = self.issues.where(~F.col("ruleId").isin(counted)).groupBy("ruleId", "rowId").agg(F.size(F.collect_set("columnId")).alias("k"))
            parts.append(rows.groupBy("ruleId").agg(F.count(F.lit(1)).alias("affectedRows"), F.sum("k").alias("affectedCells")))
        found, zero = reduce(DataFrame.unionByName, parts), F.lit(0).cast("long")
        ids = spark.createDataFrame([(n,) for n in names], "ruleId string")
        return ids.join(found, "ruleId", "left").select("ruleId", F.coalesce("affectedRows", zero).alias("affectedRows"), F.coalesce("affectedCells", zero).alias("affectedCells"))

    def counted(self, names: list[str]) -> DataFrame:
        """Rows and cells that fail rules which look at one row."""
        checks: dict[str, dict[str, list[Column]]] = {n: {} for n in names}
        for _, name, rule in self.local:
            for c in row_checks(self.frame, rule) if name in checks else []:
                checks[name].setdefault(c.column_id, []).append(c.fails)
        either = lambda fails: reduce(lambda a, b: a | b, fails, F.lit(False))
        rows = [F.count_if(either([f for own in checks[n].values() for f in own])) for n in names]
        cells = [reduce(lambda a, b: a + b, [F.count_if(either(own)) for own in checks[n].values()], F.lit(0).cast("long")) for n in names]
        said = [F.struct(F.lit(n).alias("ruleId"), r.alias("affectedRows"), c.alias("affectedCells")) for n, r, c in zip(names, rows, cells)]
        return self.frame.df.agg(F.array(*said).alias("said")).select(F.inline("said"))


def local_checks(v: Value, rule: dict) -> list[Check]:
    """Checks of one column."""
    text = lambda code, arg: MESSAGES[code].format(number_label(arg))
    return [Check(sure(failure(v, check, Params(rule))), rule["columnId"], code, text(code, arg)) for check, code, arg in parts_of(rule)]


def compares(left: Value, operator: str, right: Value) -> Column:
    if operator in ("equals", "notEquals"):
        same = sure(left.same(right))
        return same if operator == "equals" else ~same
    return ordered_numbers(left, operator, right)


def row_checks(frame: PreparedFrame, rule: dict) -> list[Check]:
    kind = rule["type"]
    if kind in ("comparison", "expression"):
        column = (referenced_columns(rule) or [""])[0]
        if kind == "comparison":
            side = lambda o: frame.value(o["columnId"]) if o["type"] == "column" else Value.of(o.get("value"))
            good = compares(side(rule["left"]), rule["operator"], side(rule["right"]))
        else:
            v = expression(rule["expression"], frame.value, "validate")
            good = sure(v.boolean)
        checks = [Check(~good, column, kind, MESSAGES[kind])]
    else:
        checks = local_checks(frame.value(rule["columnId"]), rule)
    when = condition(rule.get("when"), frame.value, "validate")
    return [Check(when & c.fails, c.column_id, c.code, rule.get("message") or c.message, rule.get("severity") or c.severity) for c in checks]


def cell_text(frame: PreparedFrame, column_id: str) -> tuple[Column, Column]:
    if not column_id:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    v = frame.value(column_id)
    return F.when(~v.is_null, v.text), v.tag


#: Checks that share one number of flags.
FLAGS = 60


def bits_at(i: Column, flags: list[str]) -> Column:
    """Whether the flag of check i is set."""
    number = reduce(lambda rest, k: F.when(i < F.lit((k + 1) * FLAGS), F.col(flags[k])).otherwise(rest), reversed(range(len(flags) - 1)), F.col(flags[-1]))
    return F.getbit(number, i % F.lit(FLAGS)) == 1


def local_issues(frame: PreparedFrame, rules: list[tuple[int, str, dict]]) -> DataFrame:
    """Issues of all row-local rules, in one scan. Each row's failures are flags of a few whole
    numbers; only rows with a flag are taken apart, and texts are made for failures alone."""
    found = [(index, name, part, c) for index, name, rule in rules for part, c in enumerate(row_checks(frame, rule))]
    found = found or [(0, "", 0, Check(F.lit(False), "", "", ""))]
    flags = {}
    for k in range(0, len(found), FLAGS):
        bits = [F.when(x[3].fails, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")) for j, x in enumerate(found[k : k + FLAGS])]
        flags[f"__m{k // FLAGS}"] = reduce(lambda a, b: a.bitwiseOR(b), bits)
    # taken apart by the generator alone: a filter here would be pushed below the flags and work
    # them out, and the columns they read, twice
    none = reduce(lambda a, b: a & b, [F.col(m) == 0 for m in flags])
    failing = F.filter(F.array(*map(F.lit, range(len(found)))), lambda i: bits_at(i, list(flags)))
    rows = frame.df.withColumns(flags).select("*", F.explode(F.when(~none, failing)).alias("__i"))
    said = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("__i") + 1)
    value = tag = F.lit(None).cast("string")
    for column in dict.fromkeys(c.column_id for *_, c in found):
        here = F.col("__i").isin(*[i for i, x in enumerate(found) if x[3].column_id == column])
        text, kind = cell_text(frame, column)
        value, tag = F.when(here, text).otherwise(value), F.when(here, kind).otherwise(tag)
    fields = {
        "ruleIndex": said([i for i, *_ in found]), "part": said([p for _, _, p, _ in found]).cast("long"), "value": value, "valueType": tag,
        "columnId": said([c.column_id for *_, c in found]), "code": said([c.code for *_, c in found]), "message": said([c.message for *_, c in found]),
        "severity": said([c.severity for *_, c in found]), "ruleId": said([n for _, n, _, _ in found]),
    }
    return place(frame, rows.select(*frame.hidden, *[v.alias(k) for k, v in fields.items()]), F.lit(0))


def place(frame: PreparedFrame, df: DataFrame, phase: Column) -> DataFrame:
    group = F.struct(*[F.col(n) for n, _ in frame.order])
    group = F.col("__first") if "__first" in df.columns else F.when(F.lit(False), group)
    named = df.withColumns({"rowId": F.col(ROW_ID), "sourceRowNumber": F.col(ROW_NUM), "phase": phase, "groupFirst": group})
    return named.select(*ISSUE, *PLACE, *[n for n, _ in frame.order])


def issues_of(frame: PreparedFrame, rows: DataFrame, index: int, part: Column, name: str, column_id: str, code: str, message: str, severity: str) -> DataFrame:
    value, tag = cell_text(frame, column_id)
    parts = {"columnId": column_id, "code": code, "message": message, "severity": severity, "ruleId": name}
    group = ["__first"] if "__first" in rows.columns else []
    out = rows.select(*frame.hidden, *group, F.lit(index).alias("ruleIndex"), part.cast("long").alias("part"), value.alias("value"), tag.alias("valueType"), *[F.lit(x).alias(k) for k, x in parts.items()])
    return place(frame, out, F.lit(1))


def join_keys(left: list[Value], right: list[Value]) -> tuple[list[Column], list[Column]] | None:
    """Columns that are equal where the typed values are; None if no values can be."""
    a, b = [], []
    for x, y in zip(left, right):
        if x.kind == y.kind:
            same = x.kind != NUMBER or (x.whole and y.whole)
            a.append(x.column if same else x.number)
            b.append(y.column if same else y.number)
        elif MIXED in (x.kind, y.kind):
            a.append(x.cell)
            b.append(y.cell)
        else:
            return None
    return a, b


def filled(frame: PreparedFrame, ids: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~sure(frame.value(c).empty("validate")) for c in ids])


def with_counts(frame: PreparedFrame, ids: list[str], rows: DataFrame | None = None, context: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key stands more than once (in its context), with `__first`: the place of the group's
    first row. Keys are counted and their first rows found in one aggregate, and only repeated keys
    are joined back."""
    keys = {f"__k{i}": frame.value(c).key for i, c in enumerate(ids)}
    by = [*context, *keys]
    rows = (frame.df if rows is None else rows).where(filled(frame, ids)).withColumns(keys)
    place = F.struct(*[F.col(f"__o.{n}") for n, _ in frame.order]).alias("__first")
    if first_place(frame) is not None:
        groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), first_place(frame).alias("__o")).where("__n > 1")
        return rows.join(groups.select(*by, place), by)
    repeated = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    rows = rows.join(repeated, by)
    return rows.join(first_rows(frame, rows, by).select(*by, place), by)


def matrix_issues(frame: PreparedFrame, index: int, name: str, rule: dict) -> list[DataFrame]:
    """Issues of a decision table: of its rows, and of values that are not unique among the rows that meet an entry."""
    found = matrix.entry_issues(frame, rule, lambda c: cell_text(frame, c))
    out = [place(frame, found.withColumns({"ruleIndex": F.lit(index), "ruleId": F.lit(name)}), F.lit(0))]
    for (kind, *ids), entries in matrix.unique_contexts(rule).items():
        code = "conditional_unique" if kind == "unique" else "conditional_composite_unique"
        rows = with_counts(frame, ids, matrix.in_contexts(frame, rule, entries), ("__part",))
        out.append(issues_of(frame, rows, index, F.col("__part"), name, ids[0], code, MESSAGES[code], rule.get("severity") or "warning"))
    return out


def dataset_issues(frame: PreparedFrame, index: int, name: str, rule: dict, references: dict[str, PreparedFrame]) -> list[DataFrame]:
    kind, severity, message = rule["type"], rule.get("severity") or "error", rule.get("message")
    none = F.lit(0)
    if kind in ("unique", "compositeUnique"):
        ids = [rule["columnId"]] if kind == "unique" else list(rule["columnIds"])
        code = "unique" if kind == "unique" else "composite_unique"
        return [issues_of(frame, with_counts(frame, ids), index, none, name, ids[0], code, message or MESSAGES[code], severity)]
    if kind == "reference":
        v, other = frame.value(rule["columnId"]), frame.value(rule["referenceColumnId"])
        rows = frame.df.where(filled(frame, [rule["columnId"]]))
        keys = join_keys([v], [other])
        exists = rule["mode"] == "exists"
        if keys is None:
            bad = rows if exists else rows.limit(0)
        else:
            known = frame.df.where(filled(frame, [rule["referenceColumnId"]])).select(keys[1][0].alias("__k")).distinct()
            bad = rows.withColumn("__k", keys[0][0]).join(known, "__k", "left_anti" if exists else "left_semi")
        return [issues_of(frame, bad, index, none, name, rule["columnId"], "reference", message or MESSAGES["reference"], severity)]
    return [relation_issues(frame, index, name, rule, references)]


def relation_issues(frame: PreparedFrame, index: int, name: str, rule: dict, references: dict[str, PreparedFrame]) -> DataFrame:
    other = frame if rule["source"] == "current" else references[rule["source"]]
    left, right = list(rule["leftColumnIds"]), list(rule["rightColumnIds"])
    low, high = rule["minMatches"], rule.get("maxMatches")
    rows = frame.df.where(condition(rule.get("when"), frame.value, "validate") & filled(frame, left))
    keys = join_keys([frame.value(c) for c in left], [other.value(c) for c in right])
    n = F.coalesce("__n", F.lit(0))
    if keys is None:
        rows = rows.withColumn("__n", F.lit(0))
    else:
        names = [f"__k{i}" for i in range(len(left))]
        counts = other.df.where(filled(other, right)).select(*[k.alias(a) for a, k in zip(names, keys[1])]).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
        rows = rows.withColumns(dict(zip(names, keys[0]))).join(counts, names, "left")
    bad = rows.where((n < low) | (n > high) if high is not None else n < low)
    text = RELATION_MESSAGES.get((low, high), RELATION_OTHER)
    return issues_of(frame, bad, index, F.lit(0), name, left[0], "relation", rule.get("message") or text, rule.get("severity") or "error")


def validate(frame: PreparedFrame, rules: list[dict], references: dict[str, PreparedFrame] | None = None, operation: Operation | None = None) -> ValidationResult:
    """Issues of all enabled, well-formed rules. Rule ids are given once, by place in rules. Within an
    operation the issues are written, those of row-local rules in one step and those of each other
    rule in its own; without one nothing runs until they are used."""
    references = references or {}
    errors = configuration_errors(rules, frame.ids)
    for i, r in enumerate(rules):
        if r["type"] == "relation":
            other = frame if r["source"] == "current" else references.get(r["source"])
            if other is None:
                errors.append({"ruleId": rule_id(r, i), "message": f"A fonte de relacionamento não está disponível: {r['source']}."})
            else:
                errors += [{"ruleId": rule_id(r, i), "message": f"A coluna de destino do relacionamento não existe: {c}."} for c in r["rightColumnIds"] if c not in other.ids]
    wrong = {e["ruleId"] for e in errors}
    used = [(i, rule_id(r, i), r) for i, r in enumerate(rules) if r.get("enabled") is not False and rule_id(r, i) not in wrong]
    local = [x for x in used if x[2]["type"] not in (*DATASET_RULES, "conditionalMatrix")]
    frames = [local_issues(frame, local)] if local or not used else []
    for i, name, r in used:
        if r["type"] == "conditionalMatrix":
            frames += matrix_issues(frame, i, name, r)
        elif r["type"] in DATASET_RULES:
            frames += dataset_issues(frame, i, name, r, references)
    if operation is not None:
        operation.expect(len(frames))
        frames = [operation.written("validate" if k == 0 and local else "validate-dataset", df) for k, df in enumerate(frames)]
    return ValidationResult(frame, rules, reduce(DataFrame.unionByName, frames), errors, frame.ordering, local)


def distinct_entries(frame: PreparedFrame, keys: list[str], dependents: list[str]) -> DataFrame:
    """Distinct tuples of keys and dependents, blanks as null, with `place`: first the tuple
    whose first row comes first."""
    clean = {c: F.when(~sure(frame.value(c).empty("validate")), F.col(f"`{c}`")) for c in [*keys, *dependents]}
    rows = frame.df.select(*[v.alias(k) for k, v in clean.items()], F.struct(*[F.col(n) for n, _ in frame.order]).alias("__o"))
    return rows.groupBy(*clean).agg(F.min("__o").alias("place"))


def matched_by_matrix(frame: PreparedFrame, rule: dict) -> int:
    """How many rows some entry of the matrix matches."""
    return matrix.matches(frame, rule).count()
