"""Amounts of money as text in a locale.

What a locale and a currency ask for is read once from the locale data that the JVM has (ICU): signs and symbol
around the number, marks, sizes of groups, digits and minor units. It is compiled to a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.values import let, shortest

#: From here on a double has no fraction, and its digits are those of its text.
LARGE = 1e17
DIGITS = "0123456789"


@dataclass(frozen=True)
class Money:
    """How amounts of one currency are written in one locale."""

    positive: tuple[str, str]
    negative: tuple[str, str]
    point: str
    group: str
    #: Digits of the last group and of those before it; 0: none.
    last_group: int
    other_groups: int
    #: Digits that must stand before the last group for groups to be made at all.
    least_before: int
    minor: int
    digits: str


@lru_cache(1024)
def money(locale: str, currency: str) -> Money:
    icu = (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())._jvm.com.ibm.icu
    asked = icu.util.ULocale.forLanguageTag(locale)
    form = icu.text.NumberFormat.getCurrencyInstance(asked)
    # without data for a language the root's are taken
    if not locale or form.getLocale(icu.util.ULocale.VALID_LOCALE).getLanguage() != asked.getLanguage() or asked.toLanguageTag().lower() != locale.lower():
        raise ValueError(f"Localidade desconhecida: {locale}")
    if not icu.util.Currency.isAvailable(currency, None, None) or currency != currency.upper():
        raise ValueError(f"Moeda desconhecida: {currency}")
    unit = icu.util.Currency.getInstance(currency)
    form.setCurrency(unit)
    signs = form.getDecimalFormatSymbols()
    told = icu.number.NumberFormatter.withLocale(asked).unit(unit)
    last, digits = form.getGroupingSize() if form.isGroupingUsed() else 0, "".join(signs.getDigitStrings())
    mark = signs.getMonetaryGroupingSeparatorString()
    # some locales leave numbers of four digits ungrouped
    least = next((k for k in range(1, 4) if mark in number_in(told.format(10.0 ** (last + k - 1)).toString(), digits)), 1)
    return Money(
        around(told.format(1.0).toString(), digits), around(told.format(-1.0).toString(), digits), signs.getMonetaryDecimalSeparatorString(), mark,
        last, (form.getSecondaryGroupingSize() or last) if last > 0 else 0, least, form.getMinimumFractionDigits(), digits,
    )


def number_in(text: str, digits: str) -> str:
    """From the first to the last digit."""
    places = [i for i, c in enumerate(text) if c in digits]
    return text[places[0] : places[-1] + 1]


def around(text: str, digits: str) -> tuple[str, str]:
    """What stands before and after that."""
    before, _, after = text.partition(number_in(text, digits))
    return before, after


def grouped(whole: Column, m: Money) -> Column:
    if m.last_group <= 0:
        return whole
    n = F.length(whole)
    head, tail = F.substr(whole, F.lit(1), n - m.last_group), F.substr(whole, n - m.last_group + 1)
    mark = m.group.replace("\\", "\\\\").replace("$", "\\$")
    head = F.regexp_replace(head, f"(?<=[0-9])(?=(?:[0-9]{{{m.other_groups}}})+\\z)", mark)
    return F.when(n >= m.last_group + m.least_before, F.concat(head, F.lit(m.group), tail)).otherwise(whole)


def amount(number: Column, minor: int) -> Column:
    """(whole, broken, negative) of a double: digits before and after the point, halves rounded away from zero.
    Null for what is no finite number."""
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    size = F.abs(finite)
    exact = F.round(F.when(size < LARGE, size.cast("string")).cast("decimal(38,10)"), minor).cast(f"decimal(38,{minor})").cast("string")
    long = let(shortest(F.when(size >= LARGE, size)), lambda s: F.concat(s["d"], F.repeat(F.lit("0"), s["n"] - F.length(s["d"]))))
    small = size < LARGE
    whole = F.when(small, F.split_part(exact, F.lit("."), F.lit(1))).otherwise(long)
    broken = F.when(small, F.split_part(exact, F.lit("."), F.lit(2))).otherwise("0" * minor)
    parts = F.struct(whole.alias("whole"), broken.alias("broken"), number.cast("string").startswith("-").alias("negative"))
    return F.when(finite.isNotNull(), parts)


def written(parts: Column, m: Money) -> Column:
    """An amount as its locale writes it."""
    text = grouped(parts["whole"], m)
    text = F.concat(text, F.lit(m.point), parts["broken"]) if m.minor else text
    text = F.translate(text, DIGITS, m.digits) if m.digits != DIGITS else text
    before, after = (F.when(parts["negative"], n).otherwise(p) for p, n in zip(m.positive, m.negative))
    return F.concat(before, text, after)


def currency_text(number: Column, locale: str, currency: str) -> Column:
    """Null for what is no finite number. Unknown locales and currencies raise."""
    m = money(locale, currency)
    return let(amount(number, m.minor), lambda parts: written(parts, m))
