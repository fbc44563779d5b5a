"""Check digits of Brazilian registration numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the leading digits by weights."""
    parts = F.transform(F.array(*map(F.lit, weights)), lambda w, i: w * F.substring(digits, i + 1, F.lit(1)).try_cast("int"))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def digit(digits: Column, place: int) -> Column:
    return F.substring(digits, place + 1, 1).try_cast("int")


def shaped(digits: Column, length: int) -> Column:
    """Of that length, and not one digit repeated."""
    return (F.length(digits) == length) & ~digits.rlike(r"^([0-9])\1*\z")


def is_cpf(c: Column) -> Column:
    d = digits_only(c)
    check = lambda n: weighted(d, list(range(n + 1, 1, -1))) * 10 % 11 % 10
    return shaped(d, 11) & (check(9) == digit(d, 9)) & (check(10) == digit(d, 10))


def is_cnpj(c: Column) -> Column:
    d = digits_only(c)

    def check(n: int) -> Column:
        rest = weighted(d, [(n - 1 - i) % 8 + 2 for i in range(n)]) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    return shaped(d, 14) & (check(12) == digit(d, 12)) & (check(13) == digit(d, 13))
