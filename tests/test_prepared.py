"""Commands, rules, plans and header matching on small typed tables."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tablemill.frame import ColumnInfo, FrameError, from_dataframe, make_column_id
from tablemill.functions.conditions import ConditionError
from tablemill.functions.parsing import js_number
from tablemill.operators import profile
from tablemill.operators.builders import build
from tablemill.operators.commands import apply, edit_cells
from tablemill.operators.history import PrepPipeline, columns_changed, fingerprint, rules_still_valid
from tablemill.operators.mapping import Mapping, accept_all, duplicate_destinations, identity, ignore_all, in_destination_columns, projected, reconcile, review, suggest, with_fixed_values
from tablemill.operators.merge import plan_write, rejected_sheet, value_risks
from tablemill.operators.rules import CARDINALITIES, configuration_errors, matching_rules, relation_rule, type_rules
from tablemill.operators.validate import matched_by_matrix, validate

PEOPLE = [(1, "Ana Silva", "Sao Paulo", 10.0, "31/01/2026"), (2, "Bruno", "Rio", 2.0, "2026-02-01"), (3, "Ana Silva", "", None, None)]
RICH = {"type": "predicate", "columnId": "amount", "operator": "greaterThan", "operand": {"type": "literal", "value": 5}}


@pytest.fixture(scope="module")
def people(spark):
    return from_dataframe(spark.createDataFrame(PEOPLE, "k long, name string, city string, amount double, day string"), ["k"], ["name", "city", "amount", "day"])


def column(frame, name):
    return [r[0] for r in frame.sorted().select(name).collect()]


def keys(frame):
    return column(frame, "_row_num")


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ({"type": "sort", "sorts": [{"columnId": "name", "direction": "asc"}, {"columnId": "amount", "direction": "desc"}]}, [1, 3, 2]),
        ({"type": "filter", "columnId": "city", "operator": "contains", "value": "Rio"}, [2]),
        ({"type": "filter", "columnId": "amount", "operator": "lessThan", "value": 5}, [2]),
        ({"type": "filter", "columnId": "city", "operator": "equals", "value": None}, [3]),
        ({"type": "filter", "columnId": "amount", "operator": "equals", "value": "10"}, []),
        ({"type": "removeEmptyRows", "columnIds": ["amount", "day"]}, [1, 2]),
        ({"type": "deduplicate", "columnIds": ["name"], "keep": "first"}, [1, 2]),
        ({"type": "deduplicate", "columnIds": ["name"], "keep": "last"}, [2, 3]),
    ],
)
def test_rows(people, command, want):
    assert keys(apply(people, command)) == want
    assert keys(people) == [1, 2, 3]


@pytest.mark.parametrize(
    ("command", "name", "want"),
    [
        ({"type": "combineColumns", "columnIds": ["name", "city"], "separator": " - ", "newColumn": {"id": "n", "header": "N"}}, "n", ["Ana Silva - Sao Paulo", "Bruno - Rio", "Ana Silva"]),
        ({"type": "combineColumns", "columnIds": ["name"], "separator": "", "newColumn": {"id": "n", "header": "N"}, "when": RICH}, "n", ["Ana Silva", None, None]),
        ({"type": "findReplace", "columnIds": ["city"], "find": "Sao", "replace": "São", "caseSensitive": True}, "city", ["São Paulo", "Rio", ""]),
        ({"type": "findReplace", "columnIds": ["amount"], "find": 10, "replace": 20, "when": RICH}, "amount", [20.0, 2.0, None]),
        ({"type": "findReplace", "columnIds": ["city"], "find": None, "replace": "Sem cidade"}, "city", ["Sao Paulo", "Rio", "Sem cidade"]),
        ({"type": "dateConversion", "columnId": "day", "inputFormat": "auto", "outputFormat": "yyyy-MM-dd"}, "day", ["2026-01-31", "2026-02-01", None]),
        ({"type": "numberConversion", "columnId": "amount", "decimalSeparator": ","}, "amount", [10.0, 2.0, None]),
        ({"type": "currencyConversion", "columnId": "amount", "locale": "en-US", "currency": "USD"}, "amount", ["$10.00", "$2.00", None]),
        ({"type": "prefix", "columnId": "amount", "value": "#"}, "amount", ["#10", "#2", None]),
        ({"type": "fixedValue", "columnId": "city", "value": "X", "when": RICH}, "city", ["X", "Rio", ""]),
    ],
)
def test_cells(people, command, name, want):
    assert column(apply(people, command), name) == want


def test_split_places_new_columns_after_their_source(people):
    out = apply(people, {"type": "splitColumn", "columnId": "name", "delimiter": " ", "newColumns": [{"id": "a", "header": "A"}, {"id": "b", "header": "B"}]})
    assert out.ids == ["name", "a", "b", "city", "amount", "day"]
    assert column(out, "a") == ["Ana", "Bruno", "Ana"] and column(out, "b") == ["Silva", None, "Silva"]


@pytest.mark.parametrize("bad", [{"type": "prefix", "columnId": "name"}, {"type": "deduplicate", "columnIds": ["name"], "keep": "middle"}, {"type": "conditionalRule", "condition": RICH, "updates": [{"columnId": "gone", "value": 1}]}, {"type": "sort", "sorts": [{"columnId": "none", "direction": "asc"}]}, {"type": "reorderColumns", "columnIds": ["name"]}, {"type": "nothing"}])
def test_bad_commands(people, bad):
    with pytest.raises(FrameError):
        apply(people, bad)


def test_empty_groups_are_refused(people):
    with pytest.raises(ConditionError):
        apply(people, {"type": "fixedValue", "columnId": "city", "value": "X", "when": {"type": "group", "operator": "and", "children": []}})


def test_undo_and_redo(people):
    p = PrepPipeline(people)
    p.execute({"type": "filter", "columnId": "city", "operator": "contains", "value": "Rio"})
    assert keys(p.undo()) == [1, 2, 3] and keys(p.redo()) == [2]


def test_column_ids():
    assert make_column_id("Código do Cliente", 1) == "codigo-do-cliente__1" and make_column_id("***", 2) == "column__2"


# --- rules


def codes(result):
    return [(r.rowId, r.code) for r in result.ordered().collect()]


def test_more_checks_than_one_number_of_flags_holds(people):
    rules = [{"type": "stringLength", "columnId": "name", "min": i} for i in range(1, 131)]
    got = validate(people, rules).issues.groupBy("rowId").count().collect()
    assert {r.rowId: r["count"] for r in got} == {"row-1": 121, "row-2": 125, "row-3": 121}


def test_local_rules_in_row_and_rule_order(people):
    rules = [{"type": "required", "columnId": "city"}, {"type": "numberRange", "columnId": "amount", "min": 5, "message": "baixo"}, {"type": "format", "columnId": "day", "format": "regex", "pattern": "^[0-9-]+$"}]
    result = validate(people, rules)
    assert codes(result) == [("row-1", "format"), ("row-2", "min"), ("row-3", "required")]
    assert not result.is_valid()
    low = result.issues.where("code = 'min'").first()
    assert (low.message, low.value, low.valueType, low.ruleId) == ("baixo", "2", "number", "numberRange-2")


def test_duplicate_groups_come_by_first_appearance(spark):
    f = from_dataframe(spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "A"), (5, " "), (6, " ")], "k long, v string"), ["k"])
    assert [r for r, _ in codes(validate(f, [{"type": "unique", "columnId": "v"}]))] == ["row-1", "row-4", "row-2", "row-3"]


@pytest.mark.parametrize(("low", "high", "want"), [(0, 0, {"row-2", "row-3"}), (0, 1, {"row-3"}), (1, None, {"row-1"}), (2, None, {"row-1", "row-2"})])
def test_cardinalities(spark, low, high, want):
    left = from_dataframe(spark.createDataFrame([(1, "C"), (2, "A"), (3, "B")], "k long, code string"), ["k"])
    right = from_dataframe(spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "k long, code string"), ["k"])
    rule = {"type": "relation", "source": "catalog", "leftColumnIds": ["code"], "rightColumnIds": ["code"], "minMatches": low, "maxMatches": high}
    assert {r for r, _ in codes(validate(left, [rule], {"catalog": right}))} == want
    missing = validate(left, [rule])
    assert missing.configuration_errors and missing.issues.count() == 0


def test_rules_that_cannot_hold():
    a, b = {"type": "numberRange", "columnId": "x", "min": 5}, {"type": "numberRange", "columnId": "x", "max": 3}
    assert configuration_errors([a, b], ["x"]) and configuration_errors([a, dict(a)], ["x"]) and configuration_errors([a], ["y"])
    assert not configuration_errors([a], ["x"])


# --- plans


def sheet(spark, rows, prefix="template-"):
    return from_dataframe(spark.createDataFrame(rows, "k long, id string, v string"), ["k"], ["id", "v"], prefix)


def test_update_plan(spark):
    incoming = sheet(spark, [(1, "1", "new"), (2, "2", "b"), (3, "3", "c"), (4, None, "d"), (5, "9", "x"), (6, "9", "y"), (7, "8", "z")], "row-")
    existing = sheet(spark, [(6, "1", "old"), (7, "2", "b"), (8, "8", "p"), (9, "8", "q")])
    plan = plan_write("update", incoming, existing, 5, 6, ["id"])
    got = {r.incomingRowId: (r.action, r.destinationRow, r.reason) for r in plan.rows.collect()}
    assert got == {
        "row-1": ("update", 6, None), "row-2": ("keep", 7, None), "row-3": ("insert", 10, None), "row-4": ("reject", None, "missing-update-key"),
        "row-5": ("reject", None, "incoming-duplicate-key"), "row-6": ("reject", None, "incoming-duplicate-key"), "row-7": ("reject", None, "existing-duplicate-key"),
    }
    assert {(r.scope, *r.rowIds) for r in plan.duplicates().collect()} == {("incoming", "row-5", "row-6"), ("existing", "template-8", "template-9")}


def test_rows_above_the_data_are_no_data(spark):
    incoming = sheet(spark, [(1, "1", "new"), (2, "2", "b")], "row-")
    existing = sheet(spark, [(1, "1", "title"), (3, "2", "x"), (4, "2", "y"), (6, "2", "b")])
    plan = plan_write("update", incoming, existing, 4, 5, ["id"])
    assert {r.incomingRowId: (r.action, r.destinationRow) for r in plan.rows.collect()} == {"row-1": ("insert", 7), "row-2": ("keep", 6)}
    assert plan.duplicates().count() == 0
    assert sorted(r.destinationRow for r in plan.apply().collect()) == [1, 3, 4, 6, 7]
    assert sorted(r.destinationRow for r in plan_write("replace", incoming, existing, 4, 5).apply().collect()) == [1, 3, 4, 5, 6]
    with pytest.raises(FrameError):
        plan_write("append", incoming, from_dataframe(existing.df.select("id", "v"), ["id"]), 4, 5)


@pytest.mark.parametrize(("mode", "rows"), [("replace", [6, 7]), ("append", [11, 12])])
def test_replace_and_append(spark, mode, rows):
    plan = plan_write(mode, sheet(spark, [(1, "a", "x"), (2, "b", "y")], "row-"), sheet(spark, [(9, "c", "z"), (10, "d", "w")]), 5, 6)
    assert sorted(r.destinationRow for r in plan.of("insert").collect()) == rows
    assert plan.of("clear").count() == (2 if mode == "replace" else 0)
    with pytest.raises(FrameError):
        plan_write(mode, plan.incoming, plan.existing, 6, 6)


def test_value_risks(spark):
    rows = [(1, float("nan"), "a"), (2, 1.0, "b\x0b"), (3, float("-inf"), "\ud83d\ude00\tok".encode("utf-16", "surrogatepass").decode("utf-16")), (4, None, None), (5, 2.0, "\ufffe")]
    incoming = from_dataframe(spark.createDataFrame(rows, "k long, x double, t string"), ["k"], ["x", "t"])
    existing = from_dataframe(spark.createDataFrame([(1_048_573, 1.0, "z")], "k long, x double, t string"), ["k"], ["x", "t"], prefix="template-")
    got = {(r.code, r.columnId, r.n, r.firstRow) for r in value_risks(plan_write("append", incoming, existing, 5, 6)).collect()}
    assert got == {("non-finite-cell-value", "x", 2, 1_048_574), ("forbidden-xml-character", "t", 2, 1_048_575), ("write-row-exceeds-excel-limit", None, 2, 1_048_577)}
    replaced = plan_write("replace", incoming.with_df(incoming.df.where("k = 4")), existing, 5, 6)
    assert value_risks(replaced).count() == 0


# --- header matching


def headers(*names):
    return [ColumnInfo(f"c{i}", n, i) for i, n in enumerate(names)]


def test_header_matching():
    got = suggest(headers("Dt. Nasc.", "End.", "Cliente", " "), headers("Data de Nascimento", "Endereço", "Número da fatura"))
    assert [m.destination for m in got] == ["c0", "c1", None, None]
    assert [m.confidence for m in got] == ["high", "exact", "low", "low"]
    near = suggest(headers("Código do Cliente"), headers("Cod. Cliente"))[0]
    assert 0.85 <= near.score < 1
    twice = suggest(headers("Valor", "Valor"), headers("Valor"))
    assert [m.score for m in twice] == [1, 1] and duplicate_destinations(twice) == ["c0"]


def test_reviews():
    m = suggest(headers("Valor", "Nome", "Nada"), headers("Valor", "Nome"))
    assert [x.status for x in accept_all(m)] == ["accepted", "accepted", "ignored"]
    assert {x.destination for x in ignore_all(m)} == {None}
    m = review(review(review(m, "c0", "map", "c1"), "c1", "ignore"), "c2", "fixed", "c0", 7)
    assert [(x.status, x.destination, x.value) for x in m] == [("accepted", "c1", None), ("ignored", None, None), ("fixed", "c0", 7)]
    again = reconcile(m, headers("Valor", "Nome"), headers("Valor"))
    assert [(x.status, x.destination) for x in again] == [("review-required", "c0"), ("ignored", None)]
    assert [(x.source, x.destination, x.status) for x in identity(headers("A"))] == [("c0", "c0", "accepted")]


def test_mappings_are_applied(people):
    m = [Mapping("name", "who", "exact", 1.0, "accepted"), Mapping("city", "town", "low", 0.0, "fixed", "X"), Mapping("amount", None, "low", 0.0, "ignored")]
    assert column(with_fixed_values(people, m), "city") == ["X"] * 3
    out = in_destination_columns(people, m, (ColumnInfo("town", "T", 0), ColumnInfo("who", "W", 1), ColumnInfo("none", "N", 2)))
    assert [tuple(r) for r in out.sorted().select("town", "who", "none").collect()] == [("X", "Ana Silva", None), ("X", "Bruno", None), ("X", "Ana Silva", None)]
    back = projected(out, people, m)
    assert back.ids == people.ids and column(back, "name") == column(people, "name") and column(back, "amount") == [None] * 3
    with pytest.raises(FrameError):
        in_destination_columns(people, [*m, Mapping("day", "who", "exact", 1.0, "accepted")], out.columns)


def test_fingerprints():
    m = [Mapping("a", "b", "exact", 1.0)]
    assert fingerprint("update", ["a"], m, 1) == fingerprint("update", ["a"], m, 1) != fingerprint("update", ["a"], m, 2)


# --- the rest


def test_commands_from_forms(people):
    assert build(people, "splitColumn", "name")["newColumns"] == [{"id": "parte-1__4", "header": "Parte 1"}, {"id": "parte-2__5", "header": "Parte 2"}]
    assert build(people, "splitColumn", "name")["delimiter"] == " "
    assert build(people, "currencyConversion", "amount") == {"type": "currencyConversion", "columnId": "amount", "locale": "pt-BR", "currency": "BRL"}
    assert build(people, "findReplace", "city", "a", "b", when=RICH) == {"type": "findReplace", "columnIds": ["city"], "find": "a", "replace": "b", "caseSensitive": False, "when": RICH}
    assert build(people, "reorderColumns", "day")["columnIds"] == ["day", "name", "city", "amount"]
    assert build(people, "calculatedColumn", "amount", "Dobro", " 2 ", operator="*")["expression"]["right"] == {"type": "literal", "value": 2.0}
    assert column(apply(people, build(people, "calculatedColumn", "amount", "Dobro", "2", operator="*")), "dobro__4") == [20.0, 4.0, None]
    for kind in ("sort", "removeEmptyRows", "deduplicate", "renameHeader", "dateConversion", "prefix", "suffix", "fixedValue"):
        apply(people, build(people, kind, "name", "x")).df.count()
    apply(people, build(people, "combineColumns", "name", "-", second="city"), build(people, "numberConversion", "amount"), build(people, "conditionalRule", "name", "Bruno", "Y", "city"), build(people, "filter", "city", "Y", operator="contains")).df.count()
    with pytest.raises(FrameError):
        build(people, "editCell", "name")
    rule = build(people, "conditionalRule", "name", "Bruno", "Y", "city")
    assert rule["condition"] == {"type": "predicate", "columnId": "name", "operator": "equals", "operand": {"type": "literal", "value": "Bruno"}} and rule["updates"] == [{"columnId": "city", "value": "Y"}]
    assert build(people, "conditionalRule", "name", second="city", when=RICH)["condition"] == RICH and "when" not in build(people, "sort", "name", "desc", when=RICH)
    assert build(people, "sort", "name", "desc") == {"type": "sort", "sorts": [{"columnId": "name", "direction": "desc"}]} and build(people, "deduplicate", "name", "x")["keep"] == "first"
    assert build(people, "dateConversion", "day", "dd/MM/yyyy") == {"type": "dateConversion", "columnId": "day", "inputFormat": "auto", "outputFormat": "dd/MM/yyyy"}
    assert build(people, "calculatedColumn", "amount", second="city", operator="+")["expression"]["right"] == {"type": "column", "columnId": "city"}
    assert build(people, "combineColumns", "name", "", second="city")["newColumn"] == {"id": "nova-coluna__4", "header": "Nova coluna"}


@pytest.mark.parametrize(("text", "old", "want"), [("1,5", 2.0, 1.5), ("x", 2.0, "x"), ("", 2.0, ""), ("true", False, True), ("yes", False, "yes"), ("1", "a", "1")])
def test_grid_edits(text, old, want):
    assert profile.edited_value(text, old) == want


def test_typed_input():
    assert [profile.parse_cell_input(t, k) for t, k in ((" ", "number"), ("1.234,5", "number"), ("TRUE", "boolean"), (" a ", "string"))] == [None, 1234.5, True, " a "]
    for text, kind in (("x", "number"), ("yes", "boolean")):
        with pytest.raises(TypeError):
            profile.parse_cell_input(text, kind)


def test_search_and_display(people):
    assert keys(profile.search(people, "city", "são")) == [1] and keys(profile.search(people, "name", "")) == [1, 2, 3]
    assert [r[0] for r in people.sorted().select(profile.display(people.value("amount"))).collect()] == ["10", "2", "Vazio"]
    table = people.df.sparkSession.range(10)
    assert [profile.memory_risk(table, n)[1] for n in (80, 79, 1)] == ["safe", "warning", "high"]


def test_long_based_numbers(spark):
    texts = ["0x" + "F" * 20, "0x0000000000000000001f", "0b" + "1" * 70, "0o7777777777777777777777777", "0x", "0x20000000000001", "0x20000000000003", "0x200000000000010000000001", "0b0", "0x" + "f" * 300]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(js_number(F.col("t"))).collect()]
    assert got[-1] == float("inf")
    assert got[:-1] == [None if t == "0x" else float(int(t, 0)) for t in texts[:-1]]


def test_patterns_are_judged_by_what_runs_them(people):
    rule = lambda p: {"type": "format", "columnId": "name", "format": "regex", "pattern": p}
    assert not configuration_errors([rule("^(?<a>A).*")], people.ids) and configuration_errors([rule("(?P<a>A)")], people.ids) and configuration_errors([rule("(")], people.ids)
    assert {r for r, _ in codes(validate(people, [rule("^(?<a>A).*"), rule("(?P<a>A)")]))} == {"row-2"}


def test_many_edits(people):
    edits = [{"rowId": "row-2", "columnId": "city", "value": str(i)} for i in range(3_000)] + [{"rowId": "row-1", "columnId": "amount", "value": 3}, {"rowId": "row-3", "columnId": "city", "value": None}]
    out = edit_cells(people, edits)
    assert column(out, "city") == ["Sao Paulo", "2999", None] and column(out, "amount") == [3.0, 2.0, None]
    with pytest.raises(FrameError):
        apply(people, {"type": "editCell", "rowId": "row-9", "columnId": "city", "value": "x"})


def test_first_rows_under_any_order(spark):
    """A hot key and nulls in the order, in both directions, against sorting by hand."""
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", None if i % 5 == 0 else i % 7) for i in range(200)]
    f = from_dataframe(spark.createDataFrame(rows, "k long, key string, v long"), ["k"], ["key", "v"])
    for direction in ("asc", "desc"):
        s = apply(f, {"type": "sort", "sorts": [{"columnId": "v", "direction": direction}]})
        order = [r._row_num for r in s.sorted().collect()]
        for keep in ("first", "last"):
            want = {}
            for n in order if keep == "first" else order[::-1]:
                want.setdefault(rows[n][1], n)
            got = apply(s, {"type": "deduplicate", "columnIds": ["key"], "keep": keep})
            assert sorted(keys(got)) == sorted(want.values())
        issues = codes(validate(s, [{"type": "unique", "columnId": "key"}]))
        assert len(issues) == 200 and issues[0][0] == f"row-{order[0]}"
    assert apply(f, {"type": "deduplicate", "columnIds": [], "keep": "last"}).df.count() == 1


def test_rules_from_columns_and_names(people):
    infos = [ColumnInfo("a", "A", 0, "number"), ColumnInfo("b", "B", 1, "mixed"), ColumnInfo("c", "C", 2, "string")]
    assert type_rules(infos, ("c",)) == [{"type": "type", "columnId": "a", "valueType": "number"}]
    made = [relation_rule("x", ["a"], ["b"], name) for name in CARDINALITIES]
    assert [(r["minMatches"], r.get("maxMatches")) for r in made] == list(CARDINALITIES.values())
    assert matching_rules([*made, {"type": "required", "columnId": "city", "severity": "warning"}], "CITY", "warning") == [{"type": "required", "columnId": "city", "severity": "warning"}]
    assert rules_still_valid([{"type": "required", "columnId": "city"}, {"type": "required", "columnId": "gone"}], people) == [{"type": "required", "columnId": "city"}]
    assert columns_changed(people, apply(people, {"type": "renameHeader", "columnId": "city", "header": "Z"})) and not columns_changed(people, people)
    rule = {"type": "conditionalMatrix", "keyColumnIds": ["city"], "dependentColumnIds": [], "entries": [{"conditions": {"city": {"operator": "equals", "value": "Rio"}}, "constraints": {}}]}
    assert matched_by_matrix(people, rule) == 1


def test_rejected_sheet_is_written(spark, people):
    from tablemill.operators.merge import REJECTED_SHEET
    from tablemill.sources.workbooks import workbooks

    sheet_ = rejected_sheet(validate(people, [{"type": "required", "columnId": "city"}, {"type": "numberRange", "columnId": "amount", "min": 5}]))
    assert [c.header for c in sheet_.columns][:2] == ["número da linha de origem", "name"] and len(sheet_.columns) == 9
    assert [r["original.name"] for r in sheet_.sorted().collect()] == ["Bruno", "Ana Silva"]
    assert workbooks(sheet_, REJECTED_SHEET).first().n_rows == 2
