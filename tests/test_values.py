"""Texts of numbers against their definition; row ids of composite keys."""

from __future__ import annotations

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablemill.frame import FrameError, from_dataframe, require_unique_ids
from tablemill.functions.values import number_text
from tablemill.operators.commands import apply
from tablemill.operators.validate import validate


def text_of(x: float) -> str:
    """The shortest digits (Python's own), laid out as the definition says."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    _, digits, e = Decimal(repr(x)).as_tuple()
    d = "".join(map(str, digits))
    n, d = len(d) + e, d.rstrip("0")
    sign, k = "-" * (x < 0), len(d)
    if k <= n <= 21:
        return sign + d + "0" * (n - k)
    if 0 < n <= 21:
        return sign + d[:n] + "." + d[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + d
    return f"{sign}{d[0]}{'.' * (k > 1)}{d[1:]}e{'+' if n > 0 else '-'}{abs(n - 1)}"


def some_doubles() -> list[float]:
    r = random.Random(11)
    out = [0.0, -0.0, 1.0, -1.5, 2e23, 1e21, 1e-6, 1e-7, 123456789012345680.0, 3668351071267381.5, 2.0**63, 2.0**62 + 1024, 1e22, 1e23, 9e15, 5e-324, 1.7976931348623157e308, 2.0**-44, 4.35, 0.1 + 0.2, 1e300, 1e-300, 9007199254740993.0, 98917100935606096.0]
    out += [math.nan, math.inf, -math.inf, 2.2250738585072014e-308, 9.999999999999999e22, 99999999999999990000.0]
    out += [2.0**k for k in range(-1074, 1024, 3)] + [10.0**k for k in range(-300, 301)] + [float(f"{9.5 - k}e{k}") for k in range(-20, 20)]
    out += [r.choice((-1, 1)) * r.random() * 10.0 ** r.randrange(-300, 301) for _ in range(45_000)]
    out += [r.random() * 10.0 ** r.randrange(-8, 30) for _ in range(40_000)]
    out += [float(r.randrange(10**r.randrange(15, 25))) for _ in range(10_000)] + [round(r.random() * 10**6, r.randrange(8)) for _ in range(5_000)]
    return out + [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(10_000)) if not math.isnan(x)]


def test_number_texts_by_definition(spark):
    doubles = some_doubles()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(doubles)], "i long, x double").repartition(8)
    got = {r.i: r.t for r in rows.select("i", number_text(F.col("x")).alias("t")).collect()}
    wrong = [(x, got[i], text_of(x)) for i, x in enumerate(doubles) if got[i] != text_of(x)]
    assert len(doubles) > 100_000 and not wrong, (len(wrong), wrong[:5])
    assert spark.range(1).select(number_text(F.lit(None).cast("double"))).first()[0] is None


def test_commands_and_rules_see_those_texts(spark):
    rows = [(1, 3668351071267381.5), (2, 2e23), (3, 98917100935606096.0), (4, 1e20), (5, 0.1 + 0.2)]
    f = from_dataframe(spark.createDataFrame(rows, "k long, x double"), ["k"], ["x"])
    texts = [text_of(x) for _, x in rows]
    told = lambda g, c: [r[0] for r in g.sorted().select(c).collect()]
    assert told(apply(f, {"type": "prefix", "columnId": "x", "value": "#"}), "x") == ["#" + t for t in texts]
    plus = {"type": "binary", "operator": "+", "left": {"type": "column", "columnId": "x"}, "right": {"type": "literal", "value": "!"}}
    assert told(apply(f, {"type": "calculatedColumn", "newColumn": {"id": "y", "header": "Y"}, "expression": plus}), "y") == [t + "!" for t in texts]
    issues = validate(f, [{"type": "numberPrecision", "columnId": "x", "decimalPlaces": 1}, {"type": "integer", "columnId": "x"}]).issues.collect()
    assert sorted((r.rowId, r.code) for r in issues) == [("row-1", "integer"), ("row-5", "integer"), ("row-5", "number_precision")]


KEYS = [("a|b", "c"), ("a", "b|c"), ("x", None), (None, "x"), ("", None), (None, ""), (None, None), ("a\\", "|b"), ("a\\|", "b"), ("\\N", "x"), ("a|b", "c")]


def test_row_ids_of_composite_keys(spark):
    f = from_dataframe(spark.createDataFrame(KEYS, "p string, q string"), ["p", "q"])
    assert f.df.select("_row_id").distinct().count() == len(set(KEYS))
    with pytest.raises(FrameError, match="a"):
        require_unique_ids(f)
    once = from_dataframe(spark.createDataFrame(list(set(KEYS)), "p string, q string").withColumn("v", F.lit(1)), ["p", "q"])
    assert require_unique_ids(once) is once
    assert apply(once, {"type": "deduplicate", "columnIds": ["v"], "keep": "first"}).df.count() == 1
    assert validate(once, [{"type": "unique", "columnId": "v"}]).impact().first()[1] == len(set(KEYS))
    assert from_dataframe(spark.createDataFrame([(1, 2.5)], "p long, q double"), ["p", "q"]).df.first()["_row_id"] == "row-1|2.5"
