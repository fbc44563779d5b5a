"""Amounts of money against the JVM's own formatter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablemill.frame import from_dataframe
from tablemill.functions.currency import amount, currency_text, money, written
from tablemill.operators.commands import apply

LOCALES = (
    "pt-BR pt-PT en-US en-GB en-IN en-ZA de-DE de-AT de-CH fr-FR fr-CA fr-CH es-ES es-MX es-AR it-IT nl-NL pl-PL cs-CZ sv-SE nb-NO da-DK fi-FI ru-RU uk-UA tr-TR el-GR hu-HU ro-RO bg-BG "
    "ja-JP zh-CN ko-KR hi-IN bn-BD th-TH vi-VN id-ID ar-EG he-IL fa-IR et-EE"
).split()
CURRENCIES = "BRL USD EUR GBP JPY CHF INR CNY KRW KWD BHD CLP MXN SEK PLN RUB TRY VND ILS CLF".split()
NUMBERS = [0.0, -0.0, 1.0, -1.0, 0.005, 1.005, 2.675, -0.001, 1234.5, 9999.995, -12345.678, 123456.0, 1234567.891, -98765432109.5, 3668351071267381.5, 1e17, 1.5e22, -1.5e300]


@pytest.fixture(scope="module")
def amounts(spark):
    """The numbers' parts by minor units, worked out once."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, x double").coalesce(1)
    parts = rows.select("i", *[amount(F.col("x"), k).alias(f"m{k}") for k in (0, 2, 3, 4)]).orderBy("i")
    return spark.createDataFrame(parts.collect(), parts.schema).coalesce(1)


@pytest.mark.parametrize("locale", LOCALES)
def test_equal_to_the_formatter(spark, amounts, locale):
    icu = spark._jvm.com.ibm.icu
    got = amounts.orderBy("i").select(*[written(F.col(f"m{m.minor}"), m).alias(c) for c in CURRENCIES for m in [money(locale, c)]]).collect()
    form = icu.number.NumberFormatter.withLocale(icu.util.ULocale.forLanguageTag(locale)).roundingMode(spark._jvm.java.math.RoundingMode.HALF_UP)
    for c in CURRENCIES:
        own = form.unit(icu.util.Currency.getInstance(c))
        assert [r[c] for r in got] == [own.format(x).toString() for x in NUMBERS], c


def test_groups_of_two_and_own_digits(spark):
    one = lambda x, locale, c: spark.range(1).select(currency_text(F.lit(x), locale, c)).first()[0]
    assert one(12345678.9, "en-IN", "INR") == "₹1,23,45,678.90"
    assert one(1234.5, "es-ES", "EUR") == "1234,50\xa0€" and one(12345.5, "es-ES", "EUR") == "12.345,50\xa0€"
    assert one(2e23, "en-US", "USD") == "$200,000,000,000,000,000,000,000.00"
    assert one(1234.5, "en-US", "JPY") == "¥1,235" and one(1.0, "en-US", "KWD") == "KWD\xa01.000"


@pytest.mark.parametrize(("locale", "code"), [("xx-YY", "USD"), ("", "USD"), ("pt_BR!", "USD"), ("pt-BR", "XYZ"), ("pt-BR", "usd"), ("pt-BR", "")])
def test_unknown_ones_raise(spark, locale, code):
    with pytest.raises(Exception, match="desconhecida"):
        money(locale, code)


def test_the_command(spark):
    f = from_dataframe(spark.createDataFrame([(1, 1234567.5), (2, -2.0), (3, None), (4, float("nan"))], "k long, x double"), ["k"], ["x"])
    got = apply(f, {"type": "currencyConversion", "columnId": "x", "locale": "hi-IN", "currency": "INR"})
    assert [r.x for r in got.sorted().select("x").collect()] == ["₹12,34,567.50", "-₹2.00", None, None]
