"""Pages against the whole order, and first distinct values against all of them."""

from __future__ import annotations

import math
import random
import re

import pytest

from tablemill.frame import from_dataframe
from tablemill.operators import pages, profile
from tablemill.operators.commands import apply
from tablemill.operators.validate import validate


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables would be put together to one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_frame(spark, n=1_000):
    r = random.Random(1)
    rows = [(i, r.choice(["x", "y", "", None, "zé"]), float(r.randrange(300))) for i in range(n)]
    return from_dataframe(spark.createDataFrame(rows, "k long, s string, v double").repartition(6), ["k"], ["k", "s", "v"])


def test_pages_joined_are_the_whole_order(spark):
    f = apply(some_frame(spark), {"type": "sort", "sorts": [{"columnId": "s", "direction": "desc"}, {"columnId": "v", "direction": "asc"}]})
    result = validate(f, [{"type": "required", "columnId": "s"}, {"type": "unique", "columnId": "v"}, {"type": "numberRange", "columnId": "v", "max": 200, "severity": "warning"}])
    whole = [tuple(r) for r in result.ordered().collect()]
    p = pages.issue_pages(result, 130)
    assert p.total == len(whole) and p.count == -(-len(whole) // 130) and len(p.parts) > 1
    got = [[tuple(r) for r in p.page(i).collect()] for i in range(p.count)]
    assert [r for page in got for r in page] == whole and {len(x) for x in got[:-1]} == {130}
    assert p.page(p.count).count() == 0 and p.page(-1).count() == 0
    assert all(len(p.parts_of(i)) <= 2 for i in range(p.count))
    for view, n in (("all", 1_000), ("errors", None), ("valid", None)):
        v = pages.preview_pages(result, view, 400)
        rows = [r._row_id for i in range(v.count) for r in v.page(i).collect()]
        order = [r._row_id for r in f.sorted().collect()]
        assert rows == [x for x in order if x in set(rows)] and (n is None or len(rows) == n)


def test_a_page_reads_its_own_files(spark):
    p = pages.frame_pages(some_frame(spark, 4_000), 500)
    assert len(p.parts) > 4
    for page in range(p.count):
        parts = {x for x, _, _ in p.parts_of(page)}
        assert 1 <= len(parts) <= 3
        plan = p.page(page)._jdf.queryExecution().executedPlan().toString()
        pruned = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
        assert {int(x) for x in re.findall(r"__part#[0-9]+ = ([0-9]+)", pruned)} == parts
        assert "__at" in plan.split("PushedFilters: ")[1].split("ReadSchema")[0]


def test_pages_of_nothing(spark):
    p = pages.frame_pages(some_frame(spark, 1).with_df(some_frame(spark, 1).df.limit(0)), 10)
    assert p.count == 0 and p.page(0).count() == 0


ORDERS = [[], [("v", "desc")], [("v", "asc"), ("k", "desc")], [("s", "asc")]]


@pytest.mark.parametrize("order", ORDERS, ids=range(4))
@pytest.mark.parametrize("column", ["s", "v", "k", "w"])
def test_first_distinct_values(spark, order, column):
    r = random.Random(3)
    rows = [(i, r.choice(["x", "y", "", None, "z"]), r.choice([None, math.nan, 1.5, float(r.randrange(90))]), r.choice([None, -0.0, 0.0, math.nan, float(r.randrange(2000))])) for i in range(3_000)]
    f = from_dataframe(spark.createDataFrame(rows, "k long, s string, v double, w double").repartition(5), ["k"], ["k", "s", "v", "w"])
    f = apply(f, {"type": "sort", "sorts": [{"columnId": c, "direction": d} for c, d in order]}) if order else f
    want = {}
    for x in f.sorted().select(column).collect():
        v = x[0] if x[0] != "" else None
        want.setdefault("nan" if isinstance(v, float) and math.isnan(v) else v, None)
    got = ["nan" if isinstance(x.value, float) and math.isnan(x.value) else x.value for x in profile.distinct_values(f, column, 40).collect()]
    assert got == list(want)[:40]


def test_few_rows_are_shuffled(spark):
    """Of 200,000 distinct values in 8 tasks no more than 8 times the limit leave the tasks."""
    f = from_dataframe(spark.range(0, 200_000, 1, 8).selectExpr("id AS k", "hash(id) AS value"), ["k"], ["value"])
    kept = f.df.mapInArrow(profile.first_values(f.order, f.df.schema, 50), f.df.schema)
    assert kept.count() == 8 * 50
    plan = profile.distinct_values(f, "value", 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")
