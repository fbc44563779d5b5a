"""Operations: steps that are counted, and cancelled work that leaves nothing behind."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tablemill.frame import from_dataframe
from tablemill.functions.storage import shared_dir
from tablemill.operators.commands import apply
from tablemill.operators.merge import plan_write
from tablemill.operators.progress import Cancelled, Operation, Progress
from tablemill.operators.validate import validate

RULES = [{"type": "numberRange", "columnId": "v", "min": 3}, {"type": "unique", "columnId": "v"}, {"type": "reference", "columnId": "v", "referenceColumnId": "k", "mode": "exists"}]


def folders(spark):
    path = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def small(spark):
    return from_dataframe(spark.range(200).selectExpr("id AS k", "id % 50 AS v"), ["k"], ["k", "v"])


def test_steps_are_counted_and_results_are_the_same(spark):
    said: list[Progress] = []
    f = small(spark)

    def work(op):
        g = op.written_frame("transform", apply(f, {"type": "fixedValue", "columnId": "v", "value": 7, "when": {"type": "predicate", "columnId": "v", "operator": "equals", "operand": {"type": "literal", "value": 3}}}))
        return validate(g, RULES, operation=op), plan_write("append", g, f, 1, 2, operation=op)

    op = Operation(spark, said.append).start(work)
    result, plan = op.wait(120)
    assert [p.phase for p in said] == ["transform", "validate", "validate-dataset", "validate-dataset", "plan"]
    assert [p.steps_done for p in said] == [1, 2, 3, 4, 5] and all(a.tasks_done <= b.tasks_done for a, b in zip(said, said[1:]))
    assert said[1].steps == 4 and all(p.steps_done <= p.steps and p.tasks_done <= p.tasks for p in said) and said[-1].tasks_done > 0
    plain = validate(apply(f, {"type": "fixedValue", "columnId": "v", "value": 7, "when": {"type": "predicate", "columnId": "v", "operator": "equals", "operand": {"type": "literal", "value": 3}}}), RULES)
    assert sorted(map(tuple, result.ordered().collect())) == sorted(map(tuple, plain.ordered().collect()))
    assert plan.rows.count() == 200 and not op.cancelled


def test_a_cancelled_validation_leaves_no_folder(spark):
    before = folders(spark)
    # hours of work for its second step
    many = spark.range(0, 10**9, 1, 400).select("id", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("e"))
    big = from_dataframe(many.select((F.col("id") * 1000 + F.col("e")).alias("k"), (F.hash("id", "e") % 1000).alias("v")), ["k"], ["k", "v"])
    seen = []

    def work(op):
        op.written_frame("transform", small(spark))
        return validate(big, [{"type": "numberRange", "columnId": "v", "min": 3}, {"type": "unique", "columnId": "k"}], operation=op)

    op = Operation(spark).start(work)
    until = time.monotonic() + 60
    while time.monotonic() < until and not (op.steps_done == 1 and folders(spark) - before and op.progress().tasks > 100):
        seen.append(op.steps_done)
        time.sleep(0.1)
    assert op.progress().phase == "validate" and len(folders(spark) - before) == 2
    op.cancel()
    op.cancel()
    with pytest.raises(Cancelled):
        op.wait(90)
    assert seen == sorted(seen) and op.steps_done == 1 and op.cancelled
    assert folders(spark) == before
    time.sleep(1)
    assert folders(spark) == before
    assert spark.range(10).count() == 10  # other work goes on


def test_failures_are_raised_and_cleared(spark):
    before = folders(spark)

    def work(op):
        op.written("transform", spark.range(5).toDF("k"))
        op.step("validate", lambda: spark.range(5).select(F.raise_error(F.lit("broken"))).collect())

    op = Operation(spark).start(work)
    with pytest.raises(Exception, match="broken"):
        op.wait(60)
    assert folders(spark) == before and op.steps_done == 1


def test_cancelling_between_steps_and_after_the_end(spark):
    began, go = threading.Event(), threading.Event()

    def work(op):
        op.step("transform", lambda: began.set() or go.wait(30))
        op.step("validate", lambda: pytest.fail("must not run"))

    op = Operation(spark).start(work)
    began.wait(30)
    op.cancel()
    go.set()
    with pytest.raises(Cancelled):
        op.wait(60)
    done = Operation(spark).start(lambda op: 5)
    assert done.wait(30) == 5
    done.cancel()
    assert not done.cancelled and done.wait() == 5
