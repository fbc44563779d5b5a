"""Decision tables: rows against plain Python, conflicts of entries against all pairs, and size."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from tablemill.frame import from_dataframe
from tablemill.operators import rules
from tablemill.operators.conflicts import conflicts, typed
from tablemill.operators.validate import matched_by_matrix, validate

SCHEMA = "k long, s string, n double, i long, b boolean, t string, v string, w double"
KEYS, DEPENDENTS = ["s", "n", "i", "b"], ["t", "v", "w"]
VALUES = {"s": ["a", "b", "", " ", "1"], "n": [1.0, 2.5, -0.0], "i": [1, 2, 3], "b": [True, False]}


def blank(x):
    return x is None or (isinstance(x, str) and not x.strip())


def same(x, y):
    return type(x) is type(y) and x == y if isinstance(x, (bool, str)) or isinstance(y, (bool, str)) or x is None or y is None else float(x) == float(y)


def met(row, rule, entry):
    for c in rule["keyColumnIds"]:
        node = entry["conditions"].get(c)
        if node is None or (node["operator"] == "empty" and not blank(row[c])) or (node["operator"] == "equals" and not same(row[c], node["value"])):
            return False
    return True


def broken(x, v):
    """Codes that a cell breaks."""
    number = isinstance(v, float) and not isinstance(v, bool)
    match x["type"]:
        case "required":
            return ["required"] * blank(v)
        case "empty":
            return ["empty"] * (not blank(v))
        case "equals":
            return ["equals"] * (not same(v, x["value"]))
    if blank(v):
        return []
    match x["type"]:
        case "allowed":
            return ["allowed"] * (not any(same(v, y) for y in x["allowedValues"]))
        case "notAllowed":
            return ["not_allowed"] * any(same(v, y) for y in x["disallowedValues"])
        case "numberRange":
            return ["min"] * (number and "min" in x and v < x["min"]) + ["max"] * (number and "max" in x and v > x["max"])
        case "stringLength":
            return ["min_length"] * (isinstance(v, str) and "min" in x and len(v) < x["min"]) + ["max_length"] * (isinstance(v, str) and "max" in x and len(v) > x["max"])
        case "type":
            return ["type"] * ((x["valueType"] == "number") != number)
        case "integer":
            return ["integer"] * (not (number and v == int(v)))
        case "format":
            return ["format"] * (not (isinstance(v, str) and (v.startswith(x["prefix"]) if x["format"] == "prefix" else v.endswith("b"))))
    return []


def by_hand(rows, rule):
    out = []
    for r in rows:
        hits = [e for e in rule["entries"] if met(r, rule, e)]
        if not hits and rule.get("noMatchBehavior") != "ignore":
            out.append((f"row-{r['k']}", rule["keyColumnIds"][0], "conditional_no_match"))
        out += [(f"row-{r['k']}", c, "conditional_" + code) for e in hits for c in DEPENDENTS if c in e["constraints"] for code in broken(e["constraints"][c], r[c])]
    for e in rule["entries"]:
        for c, x in e["constraints"].items():
            ids = [c] if x["type"] == "unique" else x["columnIds"] if x["type"] == "compositeUnique" else []
            own = [r for r in rows if met(r, rule, e) and ids and not any(blank(r[i]) for i in ids)]
            n = Counter(tuple(r[i] for i in ids) for r in own)
            code = "conditional_unique" if x["type"] == "unique" else "conditional_composite_unique"
            out += [(f"row-{r['k']}", ids[0], code) for r in own if n[tuple(r[i] for i in ids)] > 1]
    return sorted(out)


def some_constraint(r, c):
    text = [
        {"type": "allowed", "allowedValues": r.sample(["a", "bb", 1, True, "c"], 3)}, {"type": "notAllowed", "disallowedValues": ["a", 2]}, {"type": "stringLength", "min": r.randrange(3)},
        {"type": "stringLength", "max": 1}, {"type": "format", "format": "prefix", "prefix": r.choice("ab")}, {"type": "format", "format": "regex", "pattern": "b\\z"}, {"type": "equals", "value": r.choice(["a", None, ""])},
    ]
    number = [{"type": "numberRange", "min": r.randrange(3), "max": 2}, {"type": "numberRange", "max": 1.5}, {"type": "integer"}, {"type": "equals", "value": 1}, {"type": "allowed", "allowedValues": [1, 2.5, "a"]}]
    both = [{"type": t} for t in ("any", "required", "empty", "unique")] + [{"type": "type", "valueType": "number"}, {"type": "compositeUnique", "columnIds": [c, "s"]}]
    return r.choice((number if c == "w" else text) + both)


def some_rule(seed, n, **more):
    r = random.Random(seed)
    ways = lambda c: r.choice([{"operator": "any"}, {"operator": "any"}, {"operator": "empty"}, {"operator": "equals", "value": r.choice([*VALUES[c], None, "a", 1])}])
    entries = [{"conditions": {c: ways(c) for c in KEYS}, "constraints": {c: some_constraint(r, c) for c in r.sample(DEPENDENTS, r.randrange(1, 4))}} for _ in range(n)]
    return {"type": "conditionalMatrix", "keyColumnIds": KEYS, "dependentColumnIds": DEPENDENTS, "entries": entries, **more}


def some_rows(seed, n):
    r = random.Random(seed)
    pick = lambda values: r.choice([*values, None])
    return [{"k": k, **{c: pick(VALUES[c]) for c in KEYS}, "t": pick(["a", "bb", "", " "]), "v": pick(["ab", "c", "b"]), "w": pick([1.0, 2.0, 2.5, 0.0])} for k in range(n)]


def frame_of(spark, rows):
    return from_dataframe(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), ["k"], [*KEYS, *DEPENDENTS])


@pytest.mark.parametrize("behavior", [None, "ignore", "error"])
def test_issues_by_hand(spark, behavior):
    rows, rule = some_rows(1, 150), some_rule(2, 40, **({"noMatchBehavior": behavior} if behavior else {}))
    f = frame_of(spark, rows)
    found = matrix_issues_of(f, rule)
    assert sorted((x.rowId, x.columnId, x.code) for x in found) == by_hand(rows, rule)
    assert matched_by_matrix(f, rule) == sum(any(met(r, rule, e) for e in rule["entries"]) for r in rows)
    assert {x.severity for x in found if x.code == "conditional_no_match"} <= {"error" if behavior == "error" else "warning"}


def matrix_issues_of(frame, rule):
    """Also of rules whose entries conflict, which a validation leaves out."""
    from tablemill.operators.validate import matrix_issues

    return [x for df in matrix_issues(frame, 0, "m", rule) for x in df.collect()]


def test_messages_order_and_texts(spark):
    f = frame_of(spark, [{"k": 1, "s": "a", "n": 1.0, "i": 2**53 + 1, "b": None, "t": "bb", "v": "c", "w": 0.5}, {"k": 2, "s": "z", "n": None, "i": None, "b": None, "t": None, "v": None, "w": None}])
    entry = {"conditions": {"s": {"operator": "equals", "value": "a"}, "n": {"operator": "any"}}, "constraints": {"w": {"type": "numberRange", "min": 1, "max": 0.25}, "t": {"type": "format", "format": "regex", "pattern": "("}, "i": {"type": "empty"}}}
    rule = {"type": "conditionalMatrix", "keyColumnIds": ["s", "n"], "dependentColumnIds": ["t", "w", "i"], "entries": [entry], "noMatchBehavior": "error"}
    got = validate(f, [rule]).ordered().collect()
    assert [(x.rowId, x.code, x.value, x.message, x.severity) for x in got] == [
        ("row-1", "conditional_format", "bb", "Regra condicional: O valor não corresponde ao formato definido.", "warning"),
        ("row-1", "conditional_min", "0.5", "Regra condicional: O valor deve ser no mínimo 1.", "warning"),
        ("row-1", "conditional_max", "0.5", "Regra condicional: O valor deve ser no máximo 0.25.", "warning"),
        ("row-1", "conditional_empty", "9007199254740993", "O valor deve estar vazio para a regra condicional correspondente.", "warning"),
        ("row-2", "conditional_no_match", "z", "Nenhuma linha da matriz condicional corresponde a este registro.", "error"),
    ]
    named = {**rule, "message": "M", "severity": "error", "id": "x", "when": {"type": "predicate", "columnId": "s", "operator": "equals", "operand": {"type": "literal", "value": "z"}}}
    assert [(x.message, x.severity, x.ruleId) for x in validate(f, [named]).issues.collect()] == [("M", "error", "x")]
    assert validate(f, [{**named, "when": None}]).impact().collect()[0][1:] == (2, 4)


def test_plan_does_not_grow_with_entries(spark):
    f = frame_of(spark, some_rows(3, 50))

    def plan(n):
        entries = [{"conditions": {"s": {"operator": "equals", "value": f"s{i}"}, "n": {"operator": "any"}}, "constraints": {"w": {"type": "numberRange", "min": i}, "t": {"type": "unique"}}} for i in range(n)]
        rule = {"type": "conditionalMatrix", "keyColumnIds": ["s", "n"], "dependentColumnIds": ["w", "t"], "entries": entries}
        df = validate(f, [rule]).issues
        assert df.count() == 50  # no row meets an entry
        return df._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(10) == plan(10_000)


# --- conflicts of entries


def all_pairs(rule):
    keys, entries = rule["keyColumnIds"], rule["entries"]
    out = set()
    for i, a in enumerate(entries):
        for j in range(i + 1, len(entries)):
            b = entries[j]
            both = a["constraints"].keys() & b["constraints"].keys()
            if overlap(keys, a, b) and any(conflict(a["constraints"][c], b["constraints"][c]) for c in both):
                out.add((i, j))
    return out


def conflict(a, b):
    kinds = {a["type"], b["type"]}
    if "any" in kinds:
        return False
    if kinds == {"equals"}:
        return typed(a["value"]) != typed(b["value"])
    if kinds == {"allowed"}:
        return not {typed(x) for x in a["allowedValues"]} & {typed(x) for x in b["allowedValues"]}
    if kinds == {"type"}:
        return a["valueType"] != b["valueType"]
    if len(kinds) == 1 and kinds <= {"numberRange", "stringLength", "dateRange"}:
        lows, highs = ([x[end] for x in (a, b) if end in x] for end in ("min", "max"))
        return bool(lows) and bool(highs) and max(lows) > min(highs)
    return a != b and bool(kinds & {"empty", "equals"})


def overlap(keys, a, b):
    for c in keys:
        x, y = a["conditions"].get(c), b["conditions"].get(c)
        if x is None or y is None:
            return False
        if "any" in (x["operator"], y["operator"]):
            continue
        if x["operator"] != y["operator"] or (x["operator"] == "equals" and not same(x["value"], y["value"])):
            return False
    return True


@pytest.mark.parametrize("seed", range(5))
def test_conflicts_by_all_pairs(seed):
    rule = some_rule(seed, 70)
    r = random.Random(seed)
    for e in rule["entries"]:
        if r.random() < 0.1:
            e["conditions"].pop("s")
        if r.random() < 0.4:
            day = lambda: f"2024-0{r.randrange(1, 9)}-01"
            e["constraints"]["v"] = r.choice([{"type": "dateRange", "min": day()}, {"type": "dateRange", "max": day()}, {"type": "dateRange", "min": day(), "max": day()}, {"type": "dateRange"}])
    assert set(conflicts(rule)) == all_pairs(rule)
    assert conflicts({**rule, "entries": []}) == []


def test_conflicts_of_ten_thousand_entries():
    """Ranges and lists under shared keys; two planted conflicts."""
    entries = [{"conditions": {"a": {"operator": "equals", "value": i // 4}, "b": {"operator": "any"} if i % 4 else {"operator": "empty"}}, "constraints": {"x": {"type": "numberRange", "min": i // 4, "max": i // 4 + 5}, "y": {"type": "allowed", "allowedValues": ["all", f"v{i}"]}}} for i in range(10_000)]
    entries[5_000]["constraints"]["x"] = {"type": "numberRange", "max": -1}
    entries += [{"conditions": {"a": {"operator": "any"}, "b": {"operator": "equals", "value": "q"}}, "constraints": {"y": {"type": "allowed", "allowedValues": ["v3", "all"]}}}]
    rule = {"type": "conditionalMatrix", "keyColumnIds": ["a", "b"], "dependentColumnIds": ["x", "y"], "entries": entries}
    began = time.perf_counter()
    assert sorted(conflicts(rule)) == [(5_000, j) for j in (5_001, 5_002, 5_003)]
    assert len(rules.matrix_errors(rule, ["a", "b", "x", "y"])) == 3
    assert time.perf_counter() - began < 20
