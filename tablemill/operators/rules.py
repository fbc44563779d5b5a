"""Data-quality rules: plain dictionaries, and what can be said about them without any data."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from itertools import combinations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

from tablemill.operators.conflicts import conflicts

#: What an issue says by default, by code.
MESSAGES = {
    "required": "O preenchimento de um valor é obrigatório.",
    "empty": "O valor deve estar vazio.",
    "type": "É esperado um valor do tipo {}.",
    "allowed": "O valor não está na lista permitida.",
    "not_allowed": "O valor está bloqueado.",
    "min": "O valor deve ser no mínimo {}.",
    "max": "O valor deve ser no máximo {}.",
    "date_min": "A data deve ser igual ou posterior a {}.",
    "date_max": "A data deve ser igual ou anterior a {}.",
    "min_length": "O texto deve conter pelo menos {} caracteres.",
    "max_length": "O texto deve conter no máximo {} caracteres.",
    "integer": "O valor deve ser um número inteiro.",
    "number_precision": "O valor deve ter no máximo {} casas decimais.",
    "format": "O valor não corresponde ao formato definido.",
    "unique": "O valor deve ser único.",
    "composite_unique": "Os valores combinados devem ser únicos.",
    "comparison": "A comparação entre os valores não foi satisfeita.",
    "expression": "A expressão de validação não foi satisfeita.",
    "reference": "A referência não corresponde aos valores disponíveis.",
    "conditional_no_match": "Nenhuma linha da matriz condicional corresponde a este registro.",
    "conditional_required": "O preenchimento de um valor é obrigatório pela regra condicional correspondente.",
    "conditional_empty": "O valor deve estar vazio para a regra condicional correspondente.",
    "conditional_equals": "O valor não corresponde à regra condicional correspondente.",
    "conditional_unique": "O valor deve ser único no contexto condicional.",
    "conditional_composite_unique": "Os valores combinados devem ser únicos no contexto condicional.",
}
TYPE_LABELS = {"string": "texto", "number": "número", "date": "data", "boolean": "booleano"}
#: What a relation says, by its bounds.
RELATION_MESSAGES = {
    (0, 0): "O registro não deve possuir correspondência.",
    (1, None): "O registro deve possuir ao menos uma correspondência.",
    (1, 1): "O registro deve possuir exatamente uma correspondência.",
    (0, 1): "O registro deve possuir no máximo uma correspondência.",
    (2, None): "O registro deve possuir duas ou mais correspondências.",
}
RELATION_OTHER = "A quantidade de correspondências está fora da cardinalidade configurada."
METADATA = ("id", "name", "enabled", "severity", "message", "when")
LONGEST_PATTERN = 256


def rule_id(rule: dict, index: int) -> str:
    return rule.get("id") or f"{rule['type']}-{index + 1}"


def expression_columns(node: dict) -> list[str]:
    if node["type"] == "column":
        return [node["columnId"]]
    return [c for side in ("operand", "left", "right") if side in node for c in expression_columns(node[side])]


def referenced_columns(rule: dict) -> list[str]:
    """Columns of the checked data that a rule names; of a relation only its left ones."""
    match rule["type"]:
        case "conditionalMatrix":
            inner = [c for e in rule["entries"] for x in e["constraints"].values() if x["type"] == "compositeUnique" for c in x["columnIds"]]
            return [*rule["keyColumnIds"], *rule["dependentColumnIds"], *inner]
        case "comparison":
            return [rule[s]["columnId"] for s in ("left", "right") if rule[s]["type"] == "column"]
        case "expression":
            return expression_columns(rule["expression"])
        case "reference":
            return [rule["columnId"], rule["referenceColumnId"]]
        case "relation":
            return list(rule["leftColumnIds"])
    return list(rule["columnIds"]) if "columnIds" in rule else [rule["columnId"]]


def whole(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer() and x >= 0


def rule_errors(rule: dict, columns: list[str]) -> list[str]:
    """What is wrong with one rule; unknown columns are looked for only if columns are given."""
    out = [f"A coluna da regra não existe: {c}." for c in dict.fromkeys(referenced_columns(rule)) if columns and c not in columns]
    low, high = rule.get("min"), rule.get("max")
    match rule["type"]:
        case "allowed":
            out += ["A lista permitida não pode estar vazia."] * (not rule["allowedValues"])
        case "notAllowed":
            out += ["A lista bloqueada não pode estar vazia."] * (not rule["disallowedValues"])
        case "numberPrecision":
            out += ["A precisão decimal deve ser um inteiro não negativo."] * (not whole(rule["decimalPlaces"]))
        case "format":
            out += format_errors(rule)
        case "numberRange" | "stringLength":
            out += ["O limite mínimo não pode ser maior que o máximo."] * (low is not None and high is not None and low > high)
            out += ["O limite mínimo não pode ser negativo."] * (low is not None and low < 0)
        case "dateRange":
            out += ["A data mínima não pode ser posterior à data máxima."] * (low is not None and high is not None and low > high)
        case "compositeUnique":
            out += ["A chave composta deve conter ao menos uma coluna."] * (not rule["columnIds"])
        case "relation":
            out += relation_errors(rule)
        case "conditionalMatrix":
            out += matrix_errors(rule, columns) if columns else []
    return out


def format_errors(rule: dict) -> list[str]:
    out, kind, pattern = [], rule["format"], rule.get("pattern")
    if kind == "prefix" and not rule.get("prefix"):
        out.append("O prefixo da regra de formato não pode estar vazio.")
    if kind == "suffix" and not rule.get("suffix"):
        out.append("O sufixo da regra de formato não pode estar vazio.")
    if kind == "regex":
        if not pattern or len(pattern) > LONGEST_PATTERN:
            out.append("O padrão informado deve conter entre 1 e 256 caracteres.")
        if pattern:
            if not java_pattern(pattern):
                out.append("O padrão informado não é uma expressão regular válida.")
    return out


def java_pattern(pattern: str) -> bool:
    """Whether the engine that runs patterns takes this one; without a session, whether Python does."""
    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return False
    return True


def relation_errors(rule: dict) -> list[str]:
    left, right, low, high = rule["leftColumnIds"], rule["rightColumnIds"], rule["minMatches"], rule.get("maxMatches")
    checks = [
        (not rule["source"].strip(), "A fonte de relacionamento é obrigatória."),
        (not left, "O relacionamento deve conter ao menos uma coluna de origem."),
        (not right, "O relacionamento deve conter ao menos uma coluna de destino."),
        (len(left) != len(right), "O relacionamento deve ter a mesma quantidade de colunas em ambos os lados."),
        (not whole(low), "A cardinalidade mínima deve ser um inteiro não negativo."),
        (high is not None and not whole(high), "A cardinalidade máxima deve ser um inteiro não negativo."),
        (high is not None and low > high, "A cardinalidade mínima não pode ser maior que a máxima."),
    ]
    return [text for wrong, text in checks if wrong]


def repeated(ids: list[str]) -> list[str]:
    return [i for i, n in Counter(ids).items() if n > 1]


def matrix_errors(rule: dict, columns: list[str]) -> list[str]:
    keys, dependents, entries = rule["keyColumnIds"], rule["dependentColumnIds"], rule["entries"]
    out = []
    for what, text in ((keys, "A matriz deve conter pelo menos uma coluna-chave."), (dependents, "A matriz deve conter pelo menos uma coluna dependente."), (entries, "A matriz deve conter pelo menos uma linha.")):
        out += [text] * (not what)
    out += [f"A coluna-chave da matriz está duplicada: {c}." for c in repeated(keys)]
    out += [f"A coluna dependente da matriz está duplicada: {c}." for c in repeated(dependents)]
    out += [f"A coluna-chave da matriz não existe: {c}." for c in keys if c not in columns]
    for c in dependents:
        out += [f"A coluna dependente da matriz não existe: {c}."] * (c not in columns)
        out += [f"A coluna da matriz não pode ser chave e dependente: {c}."] * (c in keys)
    for k, e in enumerate(entries, 1):
        out += [f"A linha {k} da matriz não possui condição: {c}." for c in keys if not e["conditions"].get(c)]
        out += [f"A linha {k} da matriz possui uma coluna dependente desconhecida: {c}." for c in e["constraints"] if c not in dependents]
    out += [f"As linhas {i + 1} e {j + 1} da matriz entram em conflito para as mesmas condições." for i, j in conflicts(rule)]
    return list(dict.fromkeys(out))


def apart(a: dict, b: dict) -> bool:
    lows = [x["min"] for x in (a, b) if x.get("min") is not None]
    highs = [x["max"] for x in (a, b) if x.get("max") is not None]
    return bool(lows) and bool(highs) and max(lows) > min(highs)


def configuration_errors(rules: list[dict], columns: list[str]) -> list[dict]:
    """ruleId and message of everything that is wrong with rules, disabled ones too. Ranges of
    dates that exclude each other are found as well as ranges of numbers."""
    ids = [rule_id(r, i) for i, r in enumerate(rules)]
    out = [{"ruleId": i, "message": m} for i, r in zip(ids, rules) for m in rule_errors(r, columns)]
    bare = [json.dumps({k: v for k, v in r.items() if k not in METADATA}, sort_keys=True) for r in rules]
    for i, j in combinations(range(len(rules)), 2):
        a, b = rules[i], rules[j]
        if bare[i] == bare[j]:
            out.append({"ruleId": ids[i], "message": f"As regras {ids[i]} e {ids[j]} são duplicadas."})
        elif a["type"] == b["type"] and a["type"] in ("numberRange", "dateRange") and a["columnId"] == b["columnId"] and apart(comparable(a), comparable(b)):
            out.append({"ruleId": ids[i], "message": f"As regras {ids[i]} e {ids[j]} não possuem valores em comum."})
    return out


def comparable(rule: dict) -> dict:
    """Bounds that order: dates as yyyy-MM-dd."""
    turn = lambda x: f"{x[6:]}-{x[3:5]}-{x[:2]}" if isinstance(x, str) and re.fullmatch(r"\d\d/\d\d/\d{4}", x) else x
    return {k: turn(rule.get(k)) for k in ("min", "max")}


def matching_rules(rules: list[dict], text: str = "", severity: str | None = None) -> list[dict]:
    """Rules of the list whose type, columns or message hold the text, by severity if given."""
    said = lambda r: " ".join([r["type"], str(r.get("message") or ""), *referenced_columns(r)]).lower()
    return [r for r in rules if text.strip().lower() in said(r) and (severity is None or (r.get("severity") or "error") == severity)]


def type_rules(columns: list, ignored: tuple[str, ...] = ()) -> list[dict]:
    """Rules that hold columns to their detected type; mixed and empty ones are left out."""
    return [{"type": "type", "columnId": c.id, "valueType": c.detected_type} for c in columns if c.detected_type in TYPE_LABELS and c.id not in ignored]


#: Bounds of a relation by name.
CARDINALITIES = {"none": (0, 0), "at-most-one": (0, 1), "exactly-one": (1, 1), "at-least-one": (1, None), "two-or-more": (2, None)}


def relation_rule(source: str, left: list[str], right: list[str], cardinality: str = "at-least-one", **more) -> dict:
    low, high = CARDINALITIES[cardinality]
    bounds = {"minMatches": low} | ({"maxMatches": high} if high is not None else {})
    return {"type": "relation", "source": source, "leftColumnIds": left, "rightColumnIds": right} | bounds | more


def number_label(x: object) -> str:
    if isinstance(x, float) and x.is_integer() and math.isfinite(x):
        return str(int(x))
    return str(x)
