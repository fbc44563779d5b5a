"""Queries over the test tables, one for each operator, with the SQL that must agree.

Every query reads whole tables. Order-dependent operators expose what the order decides (ranks,
survivors, destination rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ROW_NUM, ColumnInfo, PreparedFrame, from_dataframe
from tablemill.functions.documents import is_cnpj, is_cpf
from tablemill.functions.storage import new_path, numbered
from tablemill.operators import fuzzy, mapping, matrix, merge, pages, profile
from tablemill.operators.commands import apply, edit_cells
from tablemill.operators.history import PrepPipeline
from tablemill.operators.validate import ValidationResult, cell_text, distinct_entries, validate
from tablemill.sources import datasource, delimited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {
    "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "events": ["event_id"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def frame(spark: SparkSession, d: str, name: str, *columns: str, **derived: str) -> PreparedFrame:
    """A table as a frame; derived: further columns by SQL expression."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in derived.items()])
    return from_dataframe(df, KEYS[name], [*columns, *derived])


def out(f: PreparedFrame, *columns: str) -> DataFrame:
    return f.to_dataframe(metadata=False).select(*(columns or f.ids))


def literal(value: object) -> dict:
    return {"type": "literal", "value": value}


def col(column_id: str) -> dict:
    return {"type": "column", "columnId": column_id}


def test(column_id: str, operator: str, value: object = None) -> dict:
    return {"type": "predicate", "columnId": column_id, "operator": operator} | ({} if operator in ("isEmpty", "notEmpty") else {"operand": literal(value)})


def group(operator: str, *children: dict) -> dict:
    return {"type": "group", "operator": operator, "children": list(children)}


def binary(operator: str, left: dict, right: dict) -> dict:
    return {"type": "binary", "operator": operator, "left": left, "right": right}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Filter, keep each customer's first order, prefix its status."""
    f = frame(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    f = apply(
        f,
        {"type": "filter", "columnId": "o_totalprice", "operator": "greaterThan", "value": 1000},
        {"type": "deduplicate", "columnIds": ["o_custkey"], "keep": "first"},
        {"type": "prefix", "columnId": "o_orderstatus", "value": "ST-"},
    )
    return out(f)


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = """SELECT o_orderkey, o_custkey, 'ST-' || o_orderstatus AS o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""

BLANKED = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '' ELSE props END"


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_equals(spark, d):
    return out(apply(frame(spark, d, "customer", "c_custkey", "c_mktsegment"), {"type": "filter", "columnId": "c_mktsegment", "operator": "equals", "value": "BUILDING"}))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'old w')")
def filter_contains(spark, d):
    return out(apply(frame(spark, d, "part", "p_partkey", "p_name"), {"type": "filter", "columnId": "p_name", "operator": "contains", "value": "old w"}))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name > 'NATION_1'")
def filter_greater_text(spark, d):
    return out(apply(frame(spark, d, "nation", "n_nationkey", "n_name"), {"type": "filter", "columnId": "n_name", "operator": "greaterThan", "value": "NATION_1"}))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 100")
def filter_less_number(spark, d):
    return out(apply(frame(spark, d, "supplier", "s_suppkey", "s_acctbal"), {"type": "filter", "columnId": "s_acctbal", "operator": "lessThan", "value": 100}))


@query(f"SELECT event_id FROM events WHERE coalesce({BLANKED}, '') = ''")
def filter_empty(spark, d):
    return out(apply(frame(spark, d, "events", "event_id", p=BLANKED), {"type": "filter", "columnId": "p", "operator": "isEmpty"}), "event_id")


@query(f"SELECT event_id, {BLANKED} AS p FROM events WHERE coalesce({BLANKED}, '') <> ''")
def filter_not_empty(spark, d):
    return out(apply(frame(spark, d, "events", "event_id", p=BLANKED), {"type": "filter", "columnId": "p", "operator": "notEmpty"}))


PRICE_GAPS = "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus ASC NULLS LAST, {PRICE_GAPS} DESC NULLS LAST, o_orderkey) - 1 AS rank FROM orders")
def sort_stable(spark, d):
    f = apply(frame(spark, d, "orders", "o_orderkey", "o_orderstatus", price=PRICE_GAPS), {"type": "sort", "sorts": [{"columnId": "o_orderstatus", "direction": "asc"}, {"columnId": "price", "direction": "desc"}]})
    return numbered(f.df, f.ordering, "rank").select("o_orderkey", "rank")


@query(f"SELECT event_id FROM events WHERE NOT (coalesce({BLANKED}, '') = '' AND CASE WHEN event_id % 35 < 20 THEN NULL ELSE value END IS NULL)")
def remove_empty_rows(spark, d):
    f = frame(spark, d, "events", "event_id", p=BLANKED, v="CASE WHEN event_id % 35 < 20 THEN NULL ELSE value END")
    return out(apply(f, {"type": "removeEmptyRows", "columnIds": ["p", "v"]}), "event_id")


def _dedupe(keep: str):
    def run(spark, d):
        f = frame(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
        return out(apply(f, {"type": "deduplicate", "columnIds": ["o_custkey", "o_orderstatus"], "keep": keep}))

    return run


for _keep, _way in (("first", "ASC"), ("last", "DESC")):
    QUERIES[f"dedupe_{_keep}"] = _dedupe(_keep)
    ORACLE_SQL[f"dedupe_{_keep}"] = f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey {_way}) = 1"


@query("SELECT c_custkey, c_name, nullif(split_part(c_name, '#', 1), '') AS a, nullif(split_part(c_name, '#', 2), '') AS b FROM customer")
def split_column(spark, d):
    return out(apply(frame(spark, d, "customer", "c_custkey", "c_name"), {"type": "splitColumn", "columnId": "c_name", "delimiter": "#", "newColumns": [{"id": "a", "header": "A"}, {"id": "b", "header": "B"}]}))


@query("SELECT p_partkey, nullif(concat_ws(' / ', nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, ''), CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END, p_size::VARCHAR), '') AS joined FROM part")
def combine_columns(spark, d):
    f = frame(spark, d, "part", "p_partkey", "p_size", b="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END", t="CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END")
    return out(apply(f, {"type": "combineColumns", "columnIds": ["b", "t", "p_size"], "separator": " / ", "newColumn": {"id": "joined", "header": "J"}}), "p_partkey", "joined")


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"SELECT {', '.join(LINE)}, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def calc_revenue(spark, d):
    f = frame(spark, d, "lineitem", *LINE, "l_extendedprice", "l_discount")
    e = binary("*", col("l_extendedprice"), binary("-", literal(1), col("l_discount")))
    return out(apply(f, {"type": "calculatedColumn", "newColumn": {"id": "revenue", "header": "R"}, "expression": e}), *LINE, "revenue")


@query(f"SELECT {', '.join(LINE)}, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS ratio FROM lineitem")
def calc_divide_zero(spark, d):
    f = frame(spark, d, "lineitem", *LINE, "l_quantity", "l_discount")
    return out(apply(f, {"type": "calculatedColumn", "newColumn": {"id": "ratio", "header": "R"}, "expression": binary("/", col("l_quantity"), col("l_discount"))}), *LINE, "ratio")


@query("SELECT p_partkey, p_brand || p_size::VARCHAR AS label FROM part")
def calc_text_concat(spark, d):
    f = frame(spark, d, "part", "p_partkey", "p_brand", "p_size")
    return out(apply(f, {"type": "calculatedColumn", "newColumn": {"id": "label", "header": "L"}, "expression": binary("+", col("p_brand"), col("p_size"))}), "p_partkey", "label")


@query("SELECT o_orderkey, (o_orderstatus = 'F' AND o_totalprice >= 150000) OR NOT (o_orderkey % 2 <> 0) AS picked FROM orders")
def calc_logic(spark, d):
    f = frame(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", odd="o_orderkey % 2")
    e = binary("or", binary("and", binary("==", col("o_orderstatus"), literal("F")), binary(">=", col("o_totalprice"), literal(150000))), {"type": "unary", "operator": "not", "operand": col("odd")})
    return out(apply(f, {"type": "calculatedColumn", "newColumn": {"id": "picked", "header": "P"}, "expression": e}), "o_orderkey", "picked")


@query("SELECT p_partkey, replace(p_type, 'A', '<A>') AS p_type FROM part")
def find_replace_cs(spark, d):
    return out(apply(frame(spark, d, "part", "p_partkey", "p_type"), {"type": "findReplace", "columnIds": ["p_type"], "find": "A", "replace": "<$&>", "caseSensitive": True}))


@query("SELECT p_partkey, regexp_replace(p_type, 'a', '*', 'gi') AS p_type FROM part")
def find_replace_ci(spark, d):
    return out(apply(frame(spark, d, "part", "p_partkey", "p_type"), {"type": "findReplace", "columnIds": ["p_type"], "find": "a", "replace": "*"}))


@query(f"SELECT event_id, CASE WHEN coalesce({BLANKED}, '') = '' THEN 'none' ELSE props END AS p FROM events")
def find_replace_empty(spark, d):
    return out(apply(frame(spark, d, "events", "event_id", p=BLANKED), {"type": "findReplace", "columnIds": ["p"], "find": None, "replace": "none"}))


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN 99 ELSE p_size END::DOUBLE AS p_size FROM part")
def find_replace_typed(spark, d):
    return out(apply(frame(spark, d, "part", "p_partkey", "p_size"), {"type": "findReplace", "columnIds": ["p_size"], "find": 10, "replace": 99}))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day FROM orders")
def date_conversion(spark, d):
    day = "CASE WHEN o_orderkey % 5 = 0 THEN '31/02/2020' WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, 'dd/MM/yyyy') END"
    f = frame(spark, d, "orders", "o_orderkey", day=day)
    return out(apply(f, {"type": "dateConversion", "columnId": "day", "inputFormat": "auto", "outputFormat": "dd/MM/yyyy"}))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price FROM orders")
def number_conversion(spark, d):
    text = "CASE WHEN o_orderkey % 6 = 0 THEN '12x' ELSE translate(format_number(o_totalprice, 2), ',.', '.,') END"
    return out(apply(frame(spark, d, "orders", "o_orderkey", price=text), {"type": "numberConversion", "columnId": "price", "decimalSeparator": ","}))


def _currency(locale: str, code: str):
    def run(spark, d):
        return out(apply(frame(spark, d, "supplier", "s_suppkey", balance="round(s_acctbal, 2)"), {"type": "currencyConversion", "columnId": "balance", "locale": locale, "currency": code}))

    return run


_MONEY = "format('{:,.2f}', abs(round(s_acctbal, 2)))"
QUERIES["currency_pt"], QUERIES["currency_en"] = _currency("pt-BR", "BRL"), _currency("en-US", "USD")
ORACLE_SQL["currency_pt"] = f"SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || 'R$' || chr(160) || translate({_MONEY}, ',.', '.,') AS balance FROM supplier"
ORACLE_SQL["currency_en"] = f"SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || '$' || {_MONEY} AS balance FROM supplier"


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'BIG-' || o_orderstatus ELSE o_orderstatus END AS o_orderstatus FROM orders")
def prefix_when(spark, d):
    return out(apply(frame(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), {"type": "prefix", "columnId": "o_orderstatus", "value": "BIG-", "when": test("o_totalprice", "greaterThan", 200000)}), "o_orderkey", "o_orderstatus")


@query(f"SELECT event_id, CASE WHEN coalesce({BLANKED}, '') = '' THEN {BLANKED} WHEN contains(event_type, 'c') THEN props || '!' ELSE props END AS p FROM events")
def suffix_when(spark, d):
    return out(apply(frame(spark, d, "events", "event_id", "event_type", p=BLANKED), {"type": "suffix", "columnId": "p", "value": "!", "when": test("event_type", "contains", "c")}), "event_id", "p")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def fixed_value_when(spark, d):
    return out(apply(frame(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), {"type": "fixedValue", "columnId": "c_mktsegment", "value": "DEBT", "when": test("c_acctbal", "lessThanOrEqual", 0)}), "c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey, CASE WHEN (o_orderstatus = 'O' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN (o_orderstatus = 'O' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def conditional_rule(spark, d):
    node = group("or", group("and", test("o_orderstatus", "equals", "O"), test("o_totalprice", "greaterThan", 100000)), test("o_orderpriority", "equals", "1-URGENT"))
    f = frame(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return out(apply(f, {"type": "conditionalRule", "condition": node, "updates": [{"columnId": "o_orderstatus", "value": "X"}, {"columnId": "o_totalprice", "value": 0}]}), "o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'Three' WHEN 7 THEN NULL ELSE n_name END AS n_name FROM nation")
def edit_cells_query(spark, d):
    f = frame(spark, d, "nation", "n_nationkey", "n_name")
    return out(edit_cells(f, [{"rowId": "row-3", "columnId": "n_name", "value": "Three"}, {"rowId": "row-7", "columnId": "n_name", "value": None}]))


@query("SELECT n_name AS n_name, n_nationkey, n_regionkey FROM nation")
def reorder_rename(spark, d):
    f = frame(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    f = apply(f, {"type": "reorderColumns", "columnIds": ["n_name", "n_nationkey", "n_regionkey"]}, {"type": "renameHeader", "columnId": "n_name", "header": "Nation"})
    return out(f)


@query("SELECT o_orderkey, 'K-' || o_orderstatus AS o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def history_replay(spark, d):
    p = PrepPipeline(frame(spark, d, "orders", "o_orderkey", "o_orderstatus"))
    p.execute({"type": "filter", "columnId": "o_orderstatus", "operator": "equals", "value": "F"})
    p.execute({"type": "prefix", "columnId": "o_orderstatus", "value": "K-"})
    p.execute({"type": "fixedValue", "columnId": "o_orderstatus", "value": "gone"})
    p.undo(), p.undo(), p.redo()
    return out(p.frame())


@query(f"SELECT p AS value FROM (SELECT nullif({BLANKED}, '') AS p, min(event_id) AS o FROM events GROUP BY 1 ORDER BY o LIMIT 500)")
def distinct_values(spark, d):
    return profile.distinct_values(frame(spark, d, "events", "event_id", p=BLANKED), "p").select("value")


@query("""SELECT delimiter, n AS occurrences FROM (
  SELECT unnest([' ', ',', ';', '|', '-', '/', chr(9)]) AS delimiter, unnest([sum(len(string_split(t, ' ')) - 1), sum(len(string_split(t, ',')) - 1), sum(len(string_split(t, ';')) - 1),
    sum(len(string_split(t, '|')) - 1), sum(len(string_split(t, '-')) - 1), sum(len(string_split(t, '/')) - 1), sum(len(string_split(t, chr(9))) - 1)])::BIGINT AS n
  FROM (SELECT o_orderpriority || ';' || o_orderstatus AS t FROM orders)) WHERE n > 0""")
def profile_delimiters(spark, d):
    return profile.delimiter_counts(frame(spark, d, "orders", "o_orderkey", t="o_orderpriority || ';' || o_orderstatus"), "t")


@query("SELECT unnest(['dd/MM/yyyy', 'yyyy-MM-dd']) AS format, unnest([(SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 2 <> 0), (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0)]) AS first_key")
def profile_dates(spark, d):
    day = "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, 'dd/MM/yyyy') END"
    return profile.date_formats(frame(spark, d, "orders", "o_orderkey", day=day), "day").select("format", F.col("place._o0").alias("first_key"))


@query("SELECT ',' AS separator, count(*) FILTER (o_orderkey % 3 <> 0) AS commas, count(*) FILTER (o_orderkey % 3 = 0) AS dots FROM orders")
def profile_decimal(spark, d):
    t = "CASE WHEN o_orderkey % 3 = 0 THEN '1.5' ELSE '2,75' END"
    return profile.decimal_separator(frame(spark, d, "orders", "o_orderkey", t=t), "t")


def issues(r: ValidationResult) -> DataFrame:
    return r.issues.select("rowId", "columnId", "code", "value", "severity", "ruleId")


ORDER_DAY = "CASE WHEN o_orderkey % 11 = 0 THEN '2020-13-01' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
STATUS_GAPS = "CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END"
LOCAL_RULES = [
    {"type": "required", "columnId": "status"},
    {"type": "allowed", "columnId": "status", "allowedValues": ["F", "O"], "severity": "warning"},
    {"type": "notAllowed", "columnId": "o_orderpriority", "disallowedValues": ["5-LOW"], "id": "no-low"},
    {"type": "numberRange", "columnId": "o_custkey", "min": 10, "max": 1000},
    {"type": "dateRange", "columnId": "day", "min": "1996-01-01", "max": "31/12/2023"},
    {"type": "stringLength", "columnId": "o_orderpriority", "min": 6, "max": 8},
    {"type": "type", "columnId": "day", "valueType": "date"},
    {"type": "integer", "columnId": "half"},
    {"type": "numberPrecision", "columnId": "half", "decimalPlaces": 0, "when": test("status", "equals", "F")},
    {"type": "format", "columnId": "o_orderpriority", "format": "regex", "pattern": "^[1-3]-"},
    {"type": "empty", "columnId": "status", "when": test("o_orderpriority", "equals", "4-NOT SPECIFIED")},
]


def order_frame(spark, d) -> PreparedFrame:
    return frame(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", status=STATUS_GAPS, day=ORDER_DAY, half="o_custkey / 2")


_O = f"""o AS (SELECT 'row-' || o_orderkey AS "rowId", o_custkey, o_orderpriority AS pr, {STATUS_GAPS} AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN '2020-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, o_orderkey % 11 = 0 AS bad, o_custkey % 2 = 1 AS odd FROM orders),
x AS (SELECT *, coalesce(trim(status), '') = '' AS blank, CASE WHEN odd THEN (o_custkey // 2)::VARCHAR || '.5' ELSE (o_custkey // 2)::VARCHAR END AS h FROM o)"""
_LOCAL = f"""WITH {_O}, i AS (
  SELECT "rowId", 'status' AS "columnId", 'required' AS code, status AS value, 'error' AS severity, 'required-1' AS "ruleId" FROM x WHERE blank
  UNION ALL SELECT "rowId", 'status', 'allowed', status, 'warning', 'allowed-2' FROM x WHERE NOT blank AND status NOT IN ('F', 'O')
  UNION ALL SELECT "rowId", 'o_orderpriority', 'not_allowed', pr, 'error', 'no-low' FROM x WHERE pr = '5-LOW'
  UNION ALL SELECT "rowId", 'o_custkey', 'min', o_custkey::VARCHAR, 'error', 'numberRange-4' FROM x WHERE o_custkey < 10
  UNION ALL SELECT "rowId", 'o_custkey', 'max', o_custkey::VARCHAR, 'error', 'numberRange-4' FROM x WHERE o_custkey > 1000
  UNION ALL SELECT "rowId", 'day', 'date_min', d, 'error', 'dateRange-5' FROM x WHERE NOT bad AND d < '1996-01-01'
  UNION ALL SELECT "rowId", 'day', 'date_max', d, 'error', 'dateRange-5' FROM x WHERE NOT bad AND d > '2023-12-31'
  UNION ALL SELECT "rowId", 'o_orderpriority', 'min_length', pr, 'error', 'stringLength-6' FROM x WHERE length(pr) < 6
  UNION ALL SELECT "rowId", 'o_orderpriority', 'max_length', pr, 'error', 'stringLength-6' FROM x WHERE length(pr) > 8
  UNION ALL SELECT "rowId", 'day', 'type', d, 'error', 'type-7' FROM x WHERE bad
  UNION ALL SELECT "rowId", 'half', 'integer', h, 'error', 'integer-8' FROM x WHERE odd
  UNION ALL SELECT "rowId", 'half', 'number_precision', h, 'error', 'numberPrecision-9' FROM x WHERE odd AND status = 'F'
  UNION ALL SELECT "rowId", 'o_orderpriority', 'format', pr, 'error', 'format-10' FROM x WHERE pr[1] NOT IN ('1', '2', '3')
  UNION ALL SELECT "rowId", 'status', 'empty', status, 'error', 'empty-11' FROM x WHERE NOT blank AND pr = '4-NOT SPECIFIED')"""


@query(_LOCAL + " SELECT * FROM i")
def rule_local_issues(spark, d):
    return issues(validate(order_frame(spark, d), LOCAL_RULES))


@query(_LOCAL + """ SELECT r."ruleId", count(DISTINCT "rowId") AS "affectedRows", count(DISTINCT "rowId" || '|' || "columnId") AS "affectedCells"
FROM (SELECT unnest(['required-1', 'allowed-2', 'no-low', 'numberRange-4', 'dateRange-5', 'stringLength-6', 'type-7', 'integer-8', 'numberPrecision-9', 'format-10', 'empty-11']) AS "ruleId") r
LEFT JOIN i USING ("ruleId") GROUP BY 1""")
def rule_impact(spark, d):
    return validate(order_frame(spark, d), LOCAL_RULES).impact()


@query(_LOCAL + """ SELECT "rowId", "columnId", count(*) AS n, list_sort(list(DISTINCT code))::VARCHAR AS codes FROM i GROUP BY 1, 2""")
def issues_by_cell(spark, d):
    cells = merge.issues_by_cell(validate(order_frame(spark, d), LOCAL_RULES))
    return cells.withColumn("codes", F.concat(F.lit("["), F.array_join("codes", ", "), F.lit("]")))


@query(_LOCAL + """ SELECT "rowId" FROM x WHERE "rowId" IN (SELECT "rowId" FROM i WHERE severity = 'error')""")
def preview_errors(spark, d):
    return merge.preview(validate(order_frame(spark, d), LOCAL_RULES), "errors", severity="error").select(F.col(ROW_ID).alias("rowId"))


@query(_LOCAL + """ SELECT "rowId" FROM x WHERE "rowId" NOT IN (SELECT "rowId" FROM i)""")
def preview_valid(spark, d):
    return merge.preview(validate(order_frame(spark, d), LOCAL_RULES), "valid").select(F.col(ROW_ID).alias("rowId"))


_NINE = "lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0')"
_SUM = "list_sum(list_transform(range({n}), lambda i: substr({s}, i + 1, 1)::INT * {w}))"


def _digit_sql(s: str, n: int, w: str, cnpj: bool) -> str:
    total = _SUM.format(n=n, s=s, w=w)
    return f"(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END)::INT" if cnpj else f"(({total} * 10 % 11) % 10)::INT"


@query(f"""WITH a AS (SELECT c_custkey, {_NINE} AS n, lpad((c_custkey * 104729 % 1000000000000)::VARCHAR, 12, '0') AS m FROM customer),
b AS (SELECT *, n || (c_custkey % 10) || (c_custkey // 10 % 10) AS cpf, m || (c_custkey % 10) || (c_custkey // 10 % 10) AS cnpj FROM a)
SELECT c_custkey, {_digit_sql('cpf', 9, '(10 - i)', False)} = substr(cpf, 10, 1)::INT AND {_digit_sql('cpf', 10, '(11 - i)', False)} = substr(cpf, 11, 1)::INT AND length(replace(cpf, cpf[1], '')) > 0 AS cpf_ok,
  {_digit_sql('cnpj', 12, '((11 - i) % 8 + 2)', True)} = substr(cnpj, 13, 1)::INT AND {_digit_sql('cnpj', 13, '((12 - i) % 8 + 2)', True)} = substr(cnpj, 14, 1)::INT AND length(replace(cnpj, cnpj[1], '')) > 0 AS cnpj_ok FROM b""")
def rule_cpf_cnpj(spark, d):
    tail = "CAST(c_custkey % 10 AS STRING) || CAST(c_custkey div 10 % 10 AS STRING)"
    nine, twelve = "lpad(CAST(c_custkey * 7919 % 1000000000 AS STRING), 9, '0')", "lpad(CAST(c_custkey * 104729 % 1000000000000 AS STRING), 12, '0')"
    f = frame(spark, d, "customer", "c_custkey", cpf=f"{nine} || {tail}", cnpj=f"{twelve} || {tail}")
    return f.df.select("c_custkey", is_cpf(F.col("cpf")).alias("cpf_ok"), is_cnpj(F.col("cnpj")).alias("cnpj_ok"))


_LINE_ID = """'row-' || concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"""


def line_frame(spark, d, *more: str, **derived: str) -> PreparedFrame:
    return frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", *more, **derived)


@query("SELECT o_custkey::VARCHAR AS value, 'row-' || o_orderkey AS \"rowId\", 'unique' AS code FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def rule_unique(spark, d):
    return validate(frame(spark, d, "orders", "o_orderkey", "o_custkey"), [{"type": "unique", "columnId": "o_custkey"}]).issues.select("value", "rowId", "code")


@query("SELECT l_orderkey::VARCHAR AS value, count(*) AS n FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1) GROUP BY 1")
def rule_composite_unique(spark, d):
    r = validate(line_frame(spark, d), [{"type": "compositeUnique", "columnIds": ["l_orderkey", "l_linenumber"]}])
    return r.issues.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT (l_discount < l_tax) GROUP BY 1")
def rule_comparison(spark, d):
    r = validate(line_frame(spark, d, "l_discount", "l_tax"), [{"type": "comparison", "left": col("l_discount"), "operator": "lessThan", "right": col("l_tax")}])
    return r.issues.select(F.split(F.substring("rowId", 5, 99), r"\|")[0].cast("long").alias("l_orderkey")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'row-' || p_partkey AS \"rowId\", p_size::VARCHAR AS value FROM part WHERE NOT (p_size * 2 + 1 < 60)")
def rule_expression(spark, d):
    e = binary("<", binary("+", binary("*", col("p_size"), literal(2)), literal(1)), literal(60))
    return validate(frame(spark, d, "part", "p_partkey", "p_size"), [{"type": "expression", "expression": e}]).issues.select("rowId", "value")


def _reference(mode: str):
    def run(spark, d):
        f = frame(spark, d, "orders", "o_orderkey", "o_custkey", half="CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey div 4 END")
        return validate(f, [{"type": "reference", "columnId": "half", "referenceColumnId": "o_custkey", "mode": mode}]).issues.select("rowId", "value")

    return run


for _mode, _not in (("exists", "NOT"), ("notExists", "")):
    QUERIES[f"rule_reference_{_mode}"] = _reference(_mode)
    ORACLE_SQL[f"rule_reference_{_mode}"] = f"""SELECT 'row-' || o_orderkey AS "rowId", (o_orderkey // 4)::VARCHAR AS value FROM orders
    WHERE o_orderkey % 3 <> 0 AND o_orderkey // 4 {_not} IN (SELECT o_custkey FROM orders)"""


@query("""SELECT 'row-' || c_custkey AS "rowId", c_custkey::VARCHAR AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE coalesce(n, 0) < 8 OR coalesce(n, 0) > 12""")
def rule_relation_cardinality(spark, d):
    rule = {"type": "relation", "source": "orders", "leftColumnIds": ["c_custkey"], "rightColumnIds": ["o_custkey"], "minMatches": 8, "maxMatches": 12}
    r = validate(frame(spark, d, "customer", "c_custkey"), [rule], {"orders": frame(spark, d, "orders", "o_orderkey", "o_custkey")})
    return r.issues.select("rowId", "value")


MATRIX = {
    "type": "conditionalMatrix",
    "keyColumnIds": ["status", "o_orderpriority"],
    "dependentColumnIds": ["o_custkey", "day"],
    "entries": [
        {"conditions": {"status": {"operator": "equals", "value": "F"}, "o_orderpriority": {"operator": "equals", "value": "1-URGENT"}}, "constraints": {"o_custkey": {"type": "numberRange", "min": 100}, "day": {"type": "type", "valueType": "date"}}},
        {"conditions": {"status": {"operator": "empty"}, "o_orderpriority": {"operator": "any"}}, "constraints": {"day": {"type": "empty"}}},
        {"conditions": {"status": {"operator": "equals", "value": "O"}, "o_orderpriority": {"operator": "any"}}, "constraints": {"o_custkey": {"type": "unique"}}},
    ],
}
_MATRIX = f"""WITH {_O}, i AS (
  SELECT "rowId", 'status' AS "columnId", 'conditional_no_match' AS code, status AS value, 'warning' AS severity FROM x WHERE NOT blank AND NOT (status = 'F' AND pr = '1-URGENT') AND status <> 'O'
  UNION ALL SELECT "rowId", 'o_custkey', 'conditional_min', o_custkey::VARCHAR, 'warning' FROM x WHERE status = 'F' AND pr = '1-URGENT' AND o_custkey < 100
  UNION ALL SELECT "rowId", 'day', 'conditional_type', d, 'warning' FROM x WHERE status = 'F' AND pr = '1-URGENT' AND bad
  UNION ALL SELECT "rowId", 'day', 'conditional_empty', d, 'warning' FROM x WHERE blank
  UNION ALL (SELECT "rowId", 'o_custkey', 'conditional_unique', o_custkey::VARCHAR, 'warning' FROM x WHERE status = 'O' QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1))"""


@query(_MATRIX + " SELECT * FROM i")
def rule_matrix(spark, d):
    return validate(order_frame(spark, d), [MATRIX]).issues.select("rowId", "columnId", "code", "value", "severity")


@query(_MATRIX + " SELECT code, count(*) AS n FROM i GROUP BY 1")
def rule_matrix_counts(spark, d):
    return validate(order_frame(spark, d), [MATRIX]).issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


#: Entries of the large table, in four masks.
ENTRIES = 10_000


def large_matrix() -> dict:
    """Entry i asks customer i div 4 + 1, with a status, without one or with any priority, for a price, a date or
    a priority."""
    is_ = lambda x: {"operator": "equals", "value": x}
    any_ = {"operator": "any"}
    entries = []
    for i in range(ENTRIES):
        customer = is_(i // 4 + 1)
        conditions = [(customer, is_("O"), any_), (customer, {"operator": "empty"}, any_), (any_, is_("F"), is_(f"{i % 7}-URGENT")), (customer, any_, is_("2-HIGH"))][i % 4]
        limit = {"type": "numberRange", "min": 1000 + i, "max": 200000 + i}
        constraints = [{"price": limit}, {"day": {"type": "type", "valueType": "date"}, "price": {"type": "numberRange", "min": 50000 + i}}, {"price": {"type": "empty"}}, {"day": {"type": "equals", "value": "1998-01-01"}}][i % 4]
        entries.append({"conditions": dict(zip(("o_custkey", "status", "o_orderpriority"), conditions)), "constraints": constraints})
    return {"type": "conditionalMatrix", "keyColumnIds": ["o_custkey", "status", "o_orderpriority"], "dependentColumnIds": ["price", "day"], "entries": entries, "noMatchBehavior": "error"}


@query(f"""WITH {_O}, y AS (SELECT x.*, o_orderkey, o_totalprice AS price FROM x JOIN orders ON 'row-' || o_orderkey = "rowId"),
e AS (SELECT i, i // 4 + 1 AS c, i % 4 AS m FROM range({ENTRIES}) r(i)),
h AS (SELECT y.*, i, m FROM y JOIN e ON e.m IN (0, 1, 3) AND e.c = y.o_custkey AND CASE m WHEN 0 THEN status = 'O' WHEN 1 THEN blank ELSE pr = '2-HIGH' END
  UNION ALL SELECT y.*, i, m FROM y JOIN e ON m = 2 AND status = 'F' AND pr = (i % 7) || '-URGENT'),
r AS (SELECT "rowId", 'price' AS col, 'conditional_min' AS code, i FROM h WHERE (m = 0 AND price < 1000 + i) OR (m = 1 AND price < 50000 + i)
  UNION ALL SELECT "rowId", 'price', 'conditional_max', i FROM h WHERE m = 0 AND price > 200000 + i
  UNION ALL SELECT "rowId", 'day', 'conditional_type', i FROM h WHERE m = 1 AND bad
  UNION ALL SELECT "rowId", 'price', 'conditional_empty', i FROM h WHERE m = 2
  UNION ALL SELECT "rowId", 'day', 'conditional_equals', i FROM h WHERE m = 3 AND d <> '1998-01-01'
  UNION ALL SELECT "rowId", 'o_custkey', 'conditional_no_match', NULL FROM y WHERE "rowId" NOT IN (SELECT "rowId" FROM h))
SELECT "rowId", col AS "columnId", code, count(*) AS n FROM r GROUP BY ALL""")
def rule_matrix_large(spark, d):
    """Ten thousand entries, looked up by joins; issues of each cell. Entries that conflict are the point of no
    rule, so this takes the table's issues without the checks of its configuration."""
    f = frame(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", status=STATUS_GAPS, day=ORDER_DAY, price="o_totalprice")
    found = matrix.entry_issues(f, large_matrix(), lambda c: cell_text(f, c))
    return found.groupBy(F.col(ROW_ID).alias("rowId"), "columnId", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_O} SELECT count(*) AS n FROM x WHERE blank OR status = 'O' OR (status = 'F' AND pr = '1-URGENT')")
def matrix_preview(spark, d):
    return matrix.matches(order_frame(spark, d), MATRIX).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) OVER () AS entries FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def matrix_distinct_entries(spark, d):
    e = distinct_entries(line_frame(spark, d, "l_returnflag", "l_linestatus"), ["l_returnflag"], ["l_linestatus"])
    return e.select("l_returnflag", "l_linestatus").join(e.agg(F.count(F.lit(1)).alias("entries")), how="cross")


def sides(spark, d) -> tuple[PreparedFrame, PreparedFrame]:
    """Incoming: orders whose key is not divisible by 3, keyed by a third of it for one in 50;
    existing: even keys, some of them above row 100, where the data begin, a third of them with another
    status."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    incoming = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 4 ELSE o_orderkey END AS id", "o_orderstatus AS s")
    existing = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey + 5 AS k", "CASE WHEN o_orderkey % 64 = 0 THEN 2 ELSE o_orderkey END AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS s")
    return from_dataframe(incoming, ["k"], ["id", "s"]), from_dataframe(existing, ["k"], ["id", "s"], prefix="template-")


_SIDES = """i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 4 ELSE o_orderkey END AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0),
e AS (SELECT o_orderkey + 5 AS k, CASE WHEN o_orderkey % 64 = 0 THEN 2 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0)"""
_UPDATE = f"""WITH {_SIDES},
i2 AS (SELECT *, count(*) OVER (PARTITION BY id) AS ni FROM i),
e2 AS (SELECT id, count(*) AS ne, min(k) AS ek, min_by(s, k) AS es FROM e WHERE k >= 100 GROUP BY id),
m AS (SELECT i2.*, ne, ek, es, CASE WHEN i2.id IS NULL THEN 'missing-update-key' WHEN ni > 1 THEN 'incoming-duplicate-key' WHEN ne > 1 THEN 'existing-duplicate-key' END AS reason FROM i2 LEFT JOIN e2 ON e2.id = i2.id),
a AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN ek IS NULL THEN 'insert' WHEN s IS NOT DISTINCT FROM es THEN 'keep' ELSE 'update' END AS action FROM m),
p AS (SELECT action, 'row-' || k AS "incomingRowId", CASE WHEN action IN ('keep', 'update') THEN 'template-' || ek END AS "existingRowId",
  CASE WHEN action = 'insert' THEN (SELECT greatest(99, max(k)) FROM e) + row_number() OVER (PARTITION BY action ORDER BY k) WHEN action IN ('keep', 'update') THEN ek END AS "destinationRow", reason, k FROM a)"""
PLAN = ("action", "incomingRowId", "existingRowId", "destinationRow", "reason")


def _plan(spark, d, mode: str):
    incoming, existing = sides(spark, d)
    return merge.plan_write(mode, incoming, existing, 99, 100, ["id"] if mode == "update" else None)


@query(_UPDATE + ' SELECT action, "incomingRowId", "existingRowId", "destinationRow", reason FROM p')
def plan_update(spark, d):
    return _plan(spark, d, "update").rows.select(*PLAN)


@query(f"""WITH {_SIDES} SELECT 'insert' AS action, 'row-' || k AS "incomingRowId", NULL::VARCHAR AS "existingRowId", (SELECT greatest(99, max(k)) FROM e) + row_number() OVER (ORDER BY k) AS "destinationRow", NULL::VARCHAR AS reason FROM i""")
def plan_append(spark, d):
    return _plan(spark, d, "append").rows.select(*PLAN)


@query(f"""WITH {_SIDES} SELECT 'insert' AS action, 'row-' || k AS "incomingRowId", NULL::VARCHAR AS "existingRowId", 99 + row_number() OVER (ORDER BY k) AS "destinationRow", NULL::VARCHAR AS reason FROM i
UNION ALL SELECT 'clear', NULL, 'template-' || k, k, NULL FROM e WHERE k >= 100""")
def plan_replace(spark, d):
    return _plan(spark, d, "replace").rows.select(*PLAN)


@query(f"""WITH {_SIDES} SELECT scope, key, rows, first FROM (
  SELECT 'incoming' AS scope, id::VARCHAR AS key, count(*) AS rows, min_by('row-' || k, k) AS first FROM i WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'existing', id::VARCHAR, count(*), min_by('template-' || k, k) FROM e WHERE k >= 100 GROUP BY id HAVING count(*) > 1)""")
def plan_duplicates(spark, d):
    return _plan(spark, d, "update").duplicates().select("scope", F.col("keyValues")[0].alias("key"), F.size("rowIds").cast("long").alias("rows"), F.col("rowIds")[0].alias("first"))


@query(_UPDATE + """ SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'keep') AS kept, 0::BIGINT AS cleared, count(*) FILTER (action = 'reject') AS rejected,
  (SELECT count(*) FROM (SELECT id FROM i WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) + (SELECT count(*) FROM e2 WHERE ne > 1) AS duplicates FROM p""")
def plan_summary(spark, d):
    return _plan(spark, d, "update").summary()


@query(_UPDATE + """ SELECT "destinationRow", id, s FROM p JOIN i USING (k) WHERE action <> 'reject'
UNION ALL SELECT k, id, s FROM e WHERE 'template-' || k NOT IN (SELECT "existingRowId" FROM p WHERE "existingRowId" IS NOT NULL)""")
def plan_applied(spark, d):
    return _plan(spark, d, "update").apply(["id", "s"])


SIDE_RULES = [{"type": "allowed", "columnId": "s", "allowedValues": ["F", "O"]}, {"type": "required", "columnId": "id", "severity": "warning"}]


@query(_UPDATE + """, bad AS (SELECT k FROM i WHERE s NOT IN ('F', 'O')), rej AS (SELECT k FROM p WHERE action = 'reject')
SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM bad) AS "errorRows", (SELECT count(*) FROM rej) AS "planRejectedRows",
  (SELECT count(*) FROM (SELECT k FROM bad UNION SELECT k FROM rej)) AS "rejectedRows", (SELECT count(*) FROM i WHERE k NOT IN (SELECT k FROM bad UNION SELECT k FROM rej)) AS "exportableRows" """)
def export_row_counts(spark, d):
    plan = _plan(spark, d, "update")
    return merge.row_counts(validate(plan.incoming, SIDE_RULES), plan)


@query(_UPDATE + """ SELECT k AS "sourceRowNumber", 's' AS "errorField", s AS "invalidValue", 'allowed' AS "failedRuleOrTransform" FROM i WHERE s NOT IN ('F', 'O')
UNION ALL SELECT p.k, 'id', '["' || coalesce(i.id::VARCHAR, '') || '"]', reason FROM p JOIN i USING (k) WHERE action = 'reject'""")
def rejected_rows(spark, d):
    plan = _plan(spark, d, "update")
    return merge.rejected_rows(validate(plan.incoming, SIDE_RULES), plan).select("sourceRowNumber", "errorField", "invalidValue", "failedRuleOrTransform")


@query(f"""WITH {_SIDES}, o AS (SELECT row_number() OVER (ORDER BY k) + 99 AS r, id::DOUBLE AS id, s FROM i)
SELECT r AS "destinationRow", id, s FROM o UNION ALL SELECT k, id, s FROM e WHERE k < 100""")
def plan_replace_applied(spark, d):
    plan = _plan(spark, d, "replace").apply(["id", "s"])
    return plan.select("destinationRow", F.col("id").cast("double").alias("id"), "s")


@query(_UPDATE + """, bad AS (SELECT k FROM i WHERE s NOT IN ('F', 'O')), g AS (SELECT * FROM p WHERE k NOT IN (SELECT k FROM bad))
SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'keep') AS kept,
  (SELECT count(*) FROM (SELECT k FROM bad UNION SELECT k FROM p WHERE action = 'reject')) AS "rejectedRows",
  ((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM i WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) + (SELECT coalesce(sum(ne), 0) FROM e2 WHERE ne > 1))::BIGINT AS "duplicateRows" FROM g""")
def export_effective_counts(spark, d):
    plan = _plan(spark, d, "update")
    return merge.effective_counts(validate(plan.incoming, SIDE_RULES), plan)


@query(_UPDATE + """, bad AS (SELECT k FROM i WHERE s NOT IN ('F', 'O')), q AS (SELECT * FROM p WHERE action <> 'reject' AND k NOT IN (SELECT k FROM bad))
SELECT action, "incomingRowId", CASE WHEN action = 'insert' THEN (SELECT min("destinationRow") FROM p WHERE action = 'insert') - 1 + row_number() OVER (PARTITION BY action ORDER BY "destinationRow") ELSE "destinationRow" END AS "destinationRow" FROM q""")
def plan_compacted(spark, d):
    plan = _plan(spark, d, "update")
    bad = validate(plan.incoming, SIDE_RULES).issues.where("severity = 'error'").select("rowId")
    return merge.compacted(plan, bad).select("action", "incomingRowId", "destinationRow")


@query(_UPDATE + """ SELECT n, id, s, field, rule FROM (
SELECT k AS n, i.id::VARCHAR AS id, s, 's' AS field, 'allowed' AS rule FROM i WHERE s NOT IN ('F', 'O')
UNION ALL SELECT p.k, i.id::VARCHAR, i.s, 'id', reason FROM p JOIN i USING (k) WHERE action = 'reject')""")
def rejected_sheet(spark, d):
    plan = _plan(spark, d, "update")
    sheet = merge.rejected_sheet(validate(plan.incoming, SIDE_RULES), plan)
    names = {"sourceRowNumber": "n", "original.id": "id", "original.s": "s", "errorField": "field", "failedRuleOrTransform": "rule"}
    rows = sheet.df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
    return rows.withColumn("id", F.nullif("id", F.lit("")))


@query("""SELECT c_custkey AS code, c_mktsegment AS segment, NULL::VARCHAR AS note, 'novo' AS origin FROM customer""")
def mapping_applied(spark, d):
    f = frame(spark, d, "customer", "c_custkey", "c_mktsegment", "c_name")
    to = tuple(ColumnInfo(i, i, k) for k, i in enumerate(("code", "segment", "note", "origin")))
    m = [mapping.Mapping("c_custkey", "code", "exact", 1.0, "accepted"), mapping.Mapping("c_mktsegment", "segment", "exact", 1.0, "accepted"), mapping.Mapping("c_name", "origin", "low", 0.0, "fixed", "novo")]
    return out(mapping.in_destination_columns(f, m, to))


_WORDS = "list_filter(string_split(regexp_replace(lower(strip_accents(header)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _headers(name: str, *tables: str) -> str:
    """Headers of tables, numbered, and their words."""
    each = " UNION ALL ".join(f"SELECT {k} AS t, row_number() OVER () AS i, column_name AS header FROM (DESCRIBE {t})" for k, t in enumerate(tables))
    return f"{name} AS (SELECT t, i, header, {_WORDS} AS w FROM ({each}))"


@query(f"""WITH {_headers("s", "lineitem", "events")}, {_headers("d", "orders", "part", "supplier", "customer")},
p AS (SELECT s.header AS source, d.header AS destination, d.t, d.i, round(0.65 * jaro_winkler_similarity(array_to_string(s.w, ' '), array_to_string(d.w, ' ')) + 0.35 * 2 * len(list_intersect(s.w, d.w)) / (len(list_distinct(s.w)) + len(list_distinct(d.w))), 4) AS score FROM s, d),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, t, i) = 1)
SELECT source, CASE WHEN score >= 0.55 THEN destination END AS destination, CASE WHEN score = 1 THEN 'exact' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN score >= 0.55 THEN score ELSE 0 END::DOUBLE AS score FROM b""")
def mapping_suggest(spark, d):
    """Suggestions for the headers of two tables among those of four others, read from their schemas."""
    infos = lambda *names: [ColumnInfo(c, c, i) for i, c in enumerate(c for n in names for c in spark.read.parquet(f"{d}/{n}.parquet").columns)]
    found = mapping.suggest(infos("lineitem", "events"), infos("orders", "part", "supplier", "customer"))
    return spark.createDataFrame([(m.source, m.destination, m.confidence, m.score) for m in found], "source string, destination string, confidence string, score double")


@query("""WITH e AS (SELECT s_suppkey + 2 AS k, s_suppkey AS code, s_name AS label FROM supplier), i AS (SELECT c_custkey AS k, c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN s_name ELSE c_name END AS n FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT CASE WHEN e.k IS NULL THEN 'insert' WHEN label = n THEN 'keep' ELSE 'update' END AS action, count(*) AS n FROM i LEFT JOIN e ON code = id GROUP BY 1""")
def plan_through_mapping(spark, d):
    """Existing suppliers under other names, seen in the columns of the incoming rows."""
    customer, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "supplier"))
    rows = customer.join(supplier, F.col("s_suppkey") == F.col("c_custkey"), "left").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN s_name ELSE c_name END AS n")
    incoming = from_dataframe(rows, ["id"], ["id", "n"])
    existing = from_dataframe(supplier.selectExpr("s_suppkey + 2 AS k", "s_suppkey AS code", "s_name AS label"), ["k"], ["code", "label"], prefix="template-")
    m = [mapping.Mapping("id", "code", "exact", 1.0, "accepted"), mapping.Mapping("n", "label", "low", 0.0, "accepted")]
    plan = merge.plan_write("update", incoming, mapping.projected(existing, incoming, m), 1, 2, ["id"])
    return plan.rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'd widget')")
def search_rows(spark, d):
    return out(profile.search(frame(spark, d, "part", "p_partkey", "p_name"), "p_name", " D  Wídget"), "p_partkey")


@query("SELECT c_custkey::DOUBLE AS code, c_name AS name, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || chr(10) || '\"x\", ' || c_nationkey END AS note FROM customer")
def csv_folder(spark, d):
    """Customers written as a folder of delimited files, quotes and line ends inside fields, and read
    back as one source, where a missing text is an empty one."""
    note = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment || '\n' || '\"x\", ' || c_nationkey END AS note"
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS code", "c_name AS name", "c_acctbal AS balance", note)
    path = new_path(spark, "csv")
    rows.repartition(3).write.csv(path, header=True, escape='"', quote='"')
    f = delimited.read_csv(spark, path)
    names = {c.id: c.header for c in f.columns}
    return f.df.select(*[F.col(f"`{i}`").alias(h) for i, h in names.items()])


@query("""SELECT c_custkey::VARCHAR AS code, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment || chr(10) || '"x", ' || c_nationkey END AS note FROM customer""")
def csv_source(spark, d):
    """Customers written as a folder of delimited files, and read by the library's own source in small splits."""
    datasource.register(spark)
    note = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment || '\n' || '\"x\", ' || c_nationkey END AS note"
    path = new_path(spark, "csv")
    spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS code", note).repartition(3).write.csv(path, header=True, escape='"', quote='"')
    df = spark.read.format("delimited").option("splitBytes", 10_000).load(path)
    return df.select(F.col("code__1").alias("code"), F.nullif("note__1", F.lit("")).alias("note"))


@query("""WITH r AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) + 1040000 AS dest FROM orders)
SELECT * FROM (SELECT 'non-finite-cell-value' AS code, 'price' AS "columnId", count(*) AS n, min(dest) AS "firstRow" FROM r WHERE k % 7 = 0
UNION ALL SELECT 'forbidden-xml-character', 'status', count(*), min(dest) FROM r WHERE k % 11 = 0
UNION ALL SELECT 'write-row-exceeds-excel-limit', NULL, count(*), min(dest) FROM r WHERE dest > 1048576) WHERE n > 0""")
def plan_value_risks(spark, d):
    """Orders appended below row 1,040,000, some with values that no sheet can hold."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    incoming = orders.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus || chr(1) ELSE o_orderstatus END AS status")
    existing = orders.where("o_orderkey < 3").selectExpr("1040000L - o_orderkey AS k", "o_totalprice AS price", "o_orderstatus AS status")
    plan = merge.plan_write("append", from_dataframe(incoming, ["k"], ["price", "status"]), from_dataframe(existing, ["k"], ["price", "status"], prefix="template-"), 99, 100)
    return merge.value_risks(plan)


_LARGE = "((o_orderkey % 3000 + 1000) * 1000000000000::DOUBLE + o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END)"


@query(f"SELECT o_orderkey, '#' || CASE WHEN o_orderkey % 3 = 0 THEN CAST({_LARGE} AS VARCHAR) ELSE CAST(CAST({_LARGE} AS BIGINT) AS VARCHAR) END AS text FROM orders")
def large_number_texts(spark, d):
    """Whole and broken numbers above 10^15 as text."""
    number = _LARGE.replace("1000000000000::DOUBLE", "CAST(1000000000000 AS DOUBLE)").replace("0.5", "CAST(0.5 AS DOUBLE)")
    return out(apply(frame(spark, d, "orders", "o_orderkey", text=number), {"type": "prefix", "columnId": "text", "value": "#"}))


_TWO_PARTS = "CASE WHEN o_orderkey % 2 = 0 THEN 'a|' || o_orderkey ELSE 'a' END AS p", "CASE WHEN o_orderkey % 2 = 0 THEN 'x' WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey - 1) || '|x' END AS q"


@query(rf"""WITH k AS (SELECT {", ".join(_TWO_PARTS)}, o_orderkey AS o FROM orders)
SELECT 'row-' || replace(p, '|', '\|') || '|' || coalesce(replace(q, '|', '\|'), '\N') || '|' || o AS "rowId" FROM k""")
def composite_row_ids(spark, d):
    """Keys whose parts hold bars and nulls: deduplication by a unique column keeps every row."""
    f = from_dataframe(spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS o", *_TWO_PARTS), ["p", "q", "o"])
    return apply(f, {"type": "deduplicate", "columnIds": ["o"], "keep": "last"}).df.select(F.col(ROW_ID).alias("rowId"))


@query("SELECT l_extendedprice AS value FROM (SELECT l_extendedprice, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY 1 ORDER BY o, l_extendedprice LIMIT 500)")
def distinct_prices(spark, d):
    """The first distinct prices of all lines: nearly all are distinct, so what is shuffled shows."""
    df = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS k", "l_extendedprice", "l_extendedprice AS price")
    return profile.distinct_values(from_dataframe(df, ["k", "price"], ["l_extendedprice"]), "l_extendedprice").select("value")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n > 700 AND n <= 1400")
def preview_page(spark, d):
    """The second page of 700 rows of all orders, the dearest first."""
    f = apply(frame(spark, d, "orders", "o_orderkey", "o_totalprice"), {"type": "sort", "sorts": [{"columnId": "o_totalprice", "direction": "desc"}]})
    return pages.frame_pages(f, 700).page(1).select("o_orderkey", "o_totalprice")


_NOISY = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' x' WHEN 2 THEN replace(p_name, 'e', 'a') WHEN 3 THEN 'the ' || p_name ELSE p_name || '!' END"
_DICE = "2.0 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / (len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' '))))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS l, lower(p_name) AS a FROM part), m AS (SELECT DISTINCT r, trim(regexp_replace(lower(r), '[^a-z0-9]+', ' ', 'g')) AS b FROM (SELECT {_NOISY} AS r FROM part)),
s AS (SELECT l, r, round(0.65 * jaro_winkler_similarity(a, b) + 0.35 * {_DICE}, 4) AS score FROM n, m) SELECT l AS "left", r AS "right", score FROM s WHERE score >= 0.85""")
def fuzzy_part_names(spark, d):
    """Names of parts and of a noisy copy that name the same thing."""
    part = spark.read.parquet(f"{d}/part.parquet")
    return fuzzy.fuzzy_keys(part, part.selectExpr(f"{_NOISY} AS noisy"), "p_name", "noisy")


_WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment = 'MACHINERY'")
def search_any_script(spark, d):
    """Greek capitals with accents, a numero sign and full-width letters, found by plain small ones."""
    label = f"CASE WHEN c_custkey % 3 = 0 THEN 'ἌΛΦΑ-№ ' || translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_WIDE}') ELSE c_mktsegment END"
    return out(profile.search(frame(spark, d, "customer", "c_custkey", label=label), "label", "αλφα numero machinery"), "c_custkey")


__all__ = ["ORACLE_SQL", "QUERIES", "ROW_NUM", "flagship"]
