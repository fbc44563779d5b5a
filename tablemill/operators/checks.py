"""Checks of one cell: what makes it fail, from bounds and lists that are literals or columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.conditions import sure
from tablemill.functions.documents import is_cnpj, is_cpf
from tablemill.functions.parsing import parsed_date
from tablemill.functions.values import BOOLEAN, MIXED, NUMBER, STRING, Value, number_text, utf16_length
from tablemill.operators.rules import TYPE_LABELS

#: Checks of a rule with two bounds: its lower one, its upper one.
BOUNDS = {"numberRange": ("min", "max"), "dateRange": ("date_min", "date_max"), "stringLength": ("min_length", "max_length")}


def parts_of(rule: dict) -> list[tuple[str, str, object]]:
    """The checks of a rule: check, code of what fails, and what its message names."""
    kind = rule["type"]
    if kind in BOUNDS:
        return [(code, code, rule[end]) for code, end in zip(BOUNDS[kind], ("min", "max")) if rule.get(end) is not None]
    match kind:
        case "type":
            return [(f"type {rule['valueType']}", "type", TYPE_LABELS[rule["valueType"]])]
        case "format":
            return [(f"format {rule['format']}", "format", None)]
        case "numberPrecision":
            return [("number_precision", "number_precision", rule["decimalPlaces"])]
        case "notAllowed":
            return [("not_allowed", "not_allowed", None)]
        case "required" | "empty" | "allowed" | "integer":
            return [(kind, kind, None)]
    raise ValueError(f"Regra desconhecida: {kind}")


class Params:
    """Where a check finds its bounds and lists: by default in the rule itself."""

    def __init__(self, rule: dict | None = None):
        self.rule = rule or {}

    def number(self, name: str) -> Column:
        return F.lit(self.rule[name])

    def text(self, name: str) -> Column:
        return F.lit(self.rule[name])

    def listed(self, v: Value, name: str) -> Column:
        return in_list(v, self.rule[name])


def in_list(v: Value, values: list) -> Column:
    """Typed membership."""
    numbers = [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    out = [v.number.isin(*numbers)] if numbers and v.kind in (NUMBER, MIXED) else []
    strings, booleans = [x for x in values if isinstance(x, str)], [x for x in values if isinstance(x, bool)]
    out += [v.string.isin(*strings)] if strings and v.kind in (STRING, MIXED) else []
    out += [v.boolean.isin(*booleans)] if booleans and v.kind in (BOOLEAN, MIXED) else []
    return reduce(lambda a, b: a | b, map(sure, out), F.lit(False))


def failure(v: Value, check: str, p: Params) -> Column:
    """Whether the cell fails the check; but for `required` and `empty` an empty cell passes."""
    blank = sure(v.empty("validate"))
    there, finite = ~blank, ~F.isnan(v.number) & (F.abs(v.number) != float("inf"))
    match check.split(" "):
        case ["required"]:
            return blank
        case ["empty"]:
            return there
        case ["type", wanted]:
            fits = {"date": parsed_date(v.string).isNotNull(), "number": finite, "string": v.string.isNotNull(), "boolean": v.boolean.isNotNull()}[wanted]
            return there & ~sure(fits)
        case ["allowed"]:
            return there & ~p.listed(v, "allowedValues")
        case ["not_allowed"]:
            return there & p.listed(v, "disallowedValues")
        case ["min"]:
            return finite & (v.number < p.number("min"))
        case ["max"]:
            return finite & (v.number > p.number("max"))
        case ["date_min"]:
            return parsed_date(v.string) < parsed_date(p.text("min"))
        case ["date_max"]:
            return parsed_date(v.string) > parsed_date(p.text("max"))
        case ["min_length"]:
            return there & (utf16_length(v.string) < p.number("min"))
        case ["max_length"]:
            return there & (utf16_length(v.string) > p.number("max"))
        case ["integer"]:
            return there & ~sure(finite & (v.number == F.rint(v.number)))
        case ["number_precision"]:
            places = F.length(F.element_at(F.split(number_text(v.number), r"\."), -1))
            return finite & F.contains(number_text(v.number), F.lit(".")) & (places > p.number("decimalPlaces"))
        case ["format", kind]:
            return there & ~sure(fits_format(v.string, kind, p))
    raise ValueError(f"Regra desconhecida: {check}")


def fits_format(c: Column, kind: str, p: Params) -> Column:
    match kind:
        case "email":
            return c.rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+\z")
        case "cpf":
            return is_cpf(c)
        case "cnpj":
            return is_cnpj(c)
        case "cep":
            return c.rlike(r"^[0-9]{5}-?[0-9]{3}\z")
        case "phone":
            return F.length(F.regexp_replace(c, "[^0-9]", "")).between(10, 13)
        case "prefix":
            return c.startswith(p.text("prefix"))
        case "suffix":
            return c.endswith(p.text("suffix"))
    return F.rlike(c, p.text("pattern"))
