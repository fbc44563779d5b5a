"""Conditions and expressions as columns, in two dialects.

transform: null and '' are empty and equal, text compares with text, + joins text.
validate: blank strings are empty, equality is typed, only numbers are ordered or added.
Both are total: a condition is true or false, never unknown.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.values import BOOLEAN, MIXED, NULL, NUMBER, STRING, Value, compared

Lookup = Callable[[str], Value]
ORDER = {"greaterThan": lambda c: c > 0, "greaterThanOrEqual": lambda c: c >= 0, "lessThan": lambda c: c < 0, "lessThanOrEqual": lambda c: c <= 0}
SIGNS = {">": "greaterThan", ">=": "greaterThanOrEqual", "<": "lessThan", "<=": "lessThanOrEqual"}
OPERATORS = ("equals", "notEquals", "contains", "isEmpty", "notEmpty", *ORDER)


class ConditionError(ValueError):
    """A condition that cannot be compiled."""


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def check_condition(node: dict, known: Lookup) -> None:
    """Raises for unknown columns, empty groups and missing operands (transform dialect)."""
    if node["type"] == "group":
        if not node["children"]:
            raise ConditionError("Um grupo de condições não pode estar vazio.")
        for child in node["children"]:
            check_condition(child, known)
        return
    known(node["columnId"])
    operand = node.get("operand")
    if node["operator"] not in ("isEmpty", "notEmpty"):
        if operand is None:
            raise ConditionError("A condição precisa de um operando.")
        if operand["type"] == "column":
            known(operand["columnId"])


def operand_value(operand: dict | None, known: Lookup) -> Value:
    if operand is None:
        return Value.of(None)
    return known(operand["columnId"]) if operand["type"] == "column" else Value.of(operand.get("value"))


def condition(node: dict | None, known: Lookup, mode: str) -> Column:
    if node is None:
        return F.lit(True)
    if node["type"] == "group":
        parts = [condition(child, known, mode) for child in node["children"]]
        both = node["operator"] == "and"
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts, F.lit(both))
    left, right = known(node["columnId"]), operand_value(node.get("operand"), known)
    return predicate(left, node["operator"], right, mode)


def predicate(left: Value, operator: str, right: Value, mode: str) -> Column:
    if operator == "isEmpty":
        return sure(left.empty(mode))
    if operator == "notEmpty":
        return ~sure(left.empty(mode))
    if operator in ("equals", "notEquals"):
        same = equal(left, right, mode)
        return same if operator == "equals" else ~same
    if operator == "contains":
        if mode == "transform":
            return sure(~left.empty(mode) & F.contains(left.text, right.text))
        return sure(F.contains(left.string, right.text))
    if mode == "transform":
        return sure(~left.empty(mode) & ~right.empty(mode) & ORDER[operator](compared(left, right)))
    return ordered_numbers(left, operator, right)


def equal(left: Value, right: Value, mode: str) -> Column:
    if mode == "transform":
        return sure((left.empty(mode) & right.empty(mode)) | (left.same(right) & ~left.empty(mode)))
    return sure(left.same(right))


def ordered_numbers(left: Value, operator: str, right: Value) -> Column:
    a, b = left.number, right.number
    return sure({"greaterThan": a > b, "greaterThanOrEqual": a >= b, "lessThan": a < b, "lessThanOrEqual": a <= b}[operator])


def truth(v: Value) -> Column:
    """False for null, '', 0, NaN and false."""
    if v.kind == NULL:
        return F.lit(False)
    parts = []
    if v.kind in (BOOLEAN, MIXED):
        parts.append(sure(v.boolean))
    if v.kind in (NUMBER, MIXED):
        parts.append(sure((v.number != 0) & ~F.isnan(v.number)))
    if v.kind in (STRING, MIXED):
        parts.append(sure(v.string != ""))
    return reduce(lambda a, b: a | b, parts)


def expression(node: dict, known: Lookup, mode: str) -> Value:
    kind = node["type"]
    if kind == "literal":
        return Value.of(node.get("value"))
    if kind == "column":
        return known(node["columnId"])
    if kind == "unary":
        v = expression(node["operand"], known, mode)
        return Value(BOOLEAN, ~truth(v)) if node["operator"] == "not" else Value(NUMBER, -v.number)
    a, b, op = expression(node["left"], known, mode), expression(node["right"], known, mode), node["operator"]
    if op == "and":
        return Value(BOOLEAN, truth(a) & truth(b))
    if op == "or":
        return Value(BOOLEAN, truth(a) | truth(b))
    if op in ("==", "!="):
        same = sure(a.same(b))
        return Value(BOOLEAN, same if op == "==" else ~same)
    if op in SIGNS:
        if mode == "validate":
            return Value(BOOLEAN, ordered_numbers(a, SIGNS[op], b))
        return Value(BOOLEAN, sure(~a.is_null & ~b.is_null & ORDER[SIGNS[op]](compared(a, b))))
    if op == "+":
        return added(a, b, mode)
    x, y = a.number, b.number
    return Value(NUMBER, {"-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op])


def added(a: Value, b: Value, mode: str) -> Value:
    numbers = a.number + b.number
    if mode == "validate" or a.kind == b.kind == NUMBER:
        return Value(NUMBER, numbers)
    there = ~a.is_null & ~b.is_null
    joined = F.when(there, F.concat(a.text, b.text))
    if MIXED not in (a.kind, b.kind):
        return Value(STRING, joined)
    both = a.number.isNotNull() & b.number.isNotNull()
    return Value(MIXED, F.when(both, Value(NUMBER, numbers).cell).otherwise(Value(STRING, joined).cell))
