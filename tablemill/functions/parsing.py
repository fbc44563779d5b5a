"""Dates and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.values import js_trim

#: Format: its shape.
DATE_FORMATS = {"yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "dd/MM/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"}


def parsed_date(c: Column, form: str = "auto") -> Column:
    """A DATE for text in the format (auto: in either), if that day exists; years under 100 are
    refused."""
    forms = DATE_FORMATS if form == "auto" else {form: DATE_FORMATS[form]}
    out = F.coalesce(*[F.when(c.rlike(shape), F.try_to_date(F.when(c.rlike(shape), c), f)) for f, shape in forms.items()])
    return F.when(F.year(out) >= 100, out)


def converted_date(c: Column, input_format: str, output_format: str) -> Column:
    if output_format not in DATE_FORMATS:
        raise ValueError(f"Formato de data desconhecido: {output_format}")
    return F.date_format(parsed_date(c, input_format), output_format)


def js_number(text: Column) -> Column:
    """Number(text) for trimmed text: decimal, hexadecimal, octal and binary forms; else null."""
    decimal = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text).try_cast("double")
    based = F.lit(None).cast("double")
    for letter, digits, base in (("xX", "0-9a-fA-F", 16), ("oO", "0-7", 8), ("bB", "01", 2)):
        shape = f"^0[{letter}][{digits}]+\\z"
        based = F.when(text.rlike(shape), based_number(F.substring(F.when(text.rlike(shape), text), 3, 2**31 - 1), base)).otherwise(based)
    return F.coalesce(decimal, based)


def based_number(digits: Column, base: int) -> Column:
    """The double nearest to digits in a base that is a power of two, however many there are: the
    first 60 bits as a whole number, whose last bit tells whether any of the rest is set, moved
    by the rest's length."""
    bits = base.bit_length() - 1
    bare = F.ltrim(digits, F.lit("0"))
    head, rest = F.substring(bare, 1, 60 // bits), F.substring(bare, 60 // bits + 1, 2**31 - 1)
    whole = F.conv(F.when(head == "", "0").otherwise(head), base, 10).try_cast("long")
    whole = F.when(rest.rlike("[^0]"), whole.bitwiseOR(1)).otherwise(whole)
    return whole.cast("double") * F.pow(F.lit(2.0), F.length(rest) * bits)


def converted_number(c: Column, separator: str) -> Column:
    """separator ',': all dots go and the first comma is the point; '.': all commas go."""
    t = js_trim(c)
    t = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), r"^([^,]*),", r"$1.") if separator == "," else F.replace(t, F.lit(","), F.lit(""))
    out = js_number(t)
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def csv_number(c: Column) -> Column:
    """A number of a delimited file: 1.234,56 or 1234.56, no exponents."""
    t = F.when(F.contains(c, F.lit(",")), F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), r"^([^,]*),", r"$1.")).otherwise(c)
    return F.when(t.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?\z"), t).try_cast("double")
