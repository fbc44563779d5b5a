"""Cell values as columns.

A cell is a string, a number, a boolean or null. A column that holds one kind of cell is a plain
Spark column; a column that mixes kinds is a struct CELL (t: kind, n: number, s: string, b:
boolean). `Value` gives both the same face, so that commands and rules are written once and
Catalyst still sees plain expressions for plain columns. Nothing here is ever SQL-unknown: tests
are true or false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, MIXED, NULL = "number", "string", "boolean", "mixed", "null"
CELL = T.StructType().add("t", "string").add("n", "double").add("s", "string").add("b", "boolean")
#: White space that trimming removes, as the source format's host language has it.
BLANKS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+\\z", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Whole numbers from 2^63 on: a bound's exponent, and that of a power of two that divides all doubles up to it.
BY_POWER = [(63 + k, k) for k in (11, 22, 33, 44, 55)]
#: Digits that tell doubles apart but for those below LEAST_NORMAL, and digits that tell any double.
SURE_DIGITS, MOST_DIGITS, LEAST_NORMAL = 15, 17, 2.0**-1022


def whole_digits(size: Column) -> Column:
    """A whole double under 2^118 as decimal, exactly; null for others."""
    out = F.when(size < 2.0**63, size.cast("bigint").cast("decimal(38,0)"))
    for bound, k in BY_POWER:
        high = (size / 2.0**k).cast("bigint").cast("decimal(19,0)") * F.lit(2**k).cast("decimal(17,0)")
        out = out.when(size < 2.0**bound, high.cast("decimal(38,0)"))
    return F.when(size == F.rint(size), out)


def rounded(s: Column, places: Column) -> Column:
    """(d, q) of s at so many digits, down or up, whichever is nearer and reads back; else null.
    s: `text` of digits, power `q` of ten, and the double, `size`."""
    cut = F.length(s["text"]) - places
    low, rest = F.substr(s["text"], F.lit(1), places).cast("bigint"), F.substr(s["text"], places + 1)
    half = F.rpad(F.lit("5"), cut, "0")
    down = (rest < half) | ((rest == half) & (low % 2 == 0))
    as_pair = lambda n: F.struct(n.cast("string").alias("d"), (s["q"] + cut).alias("q"))
    back = lambda n: F.concat(n.cast("string"), F.lit("E"), (s["q"] + cut).cast("string")).cast("double") == s["size"]
    near, far = F.when(down, low).otherwise(low + 1), F.when(down, low + 1).otherwise(low)
    return F.when(cut > 0, F.when(back(near), as_pair(near)).when(back(far), as_pair(far)))


def shortest(size: Column) -> Column:
    """(d, n) of a positive double: the fewest digits that read back as that double, and of those the
    nearest; the number is 0.d times ten to the power of n.

    Digits that read back are at hand: all those of a whole number, else what Java writes, which some
    versions give one digit too many. At 15, 16 and 17 digits (from one on for the least doubles), down and
    up, the first that still read back are the shortest."""
    written = size.cast("string")
    java, power = F.split_part(written, F.lit("E"), F.lit(1)), F.nullif(F.split_part(written, F.lit("E"), F.lit(2)), F.lit(""))
    broken = F.length(F.split_part(java, F.lit("."), F.lit(2)))
    exact, digits = whole_digits(size), F.replace(java, F.lit(".")).cast("decimal(38,0)")
    q = F.when(exact.isNotNull(), 0).otherwise(F.coalesce(power.cast("int"), F.lit(0)) - broken)
    start = F.struct(F.coalesce(exact, digits).cast("string").alias("text"), q.alias("q"), size.alias("size"))
    whole = lambda s: F.struct(s["text"].alias("d"), s["q"].alias("q"))
    places = lambda first: F.sequence(F.lit(first), F.lit(MOST_DIGITS))
    tried = lambda s: F.transform(F.when(s["size"] < LEAST_NORMAL, places(1)).otherwise(places(SURE_DIGITS)), lambda p: rounded(s, p))
    found = let(start, lambda s: F.coalesce(F.get(F.filter(tried(s), lambda x: x.isNotNull()), 0), whole(s)))
    return let(found, lambda s: F.struct(F.rtrim(s["d"], F.lit("0")).alias("d"), (F.length(s["d"]) + s["q"]).alias("n")))


def laid_out(s: Column) -> Column:
    """0.d times ten to the power of n as text: plain between 1e-6 and 1e21, else with an exponent."""
    d, n, k = s["d"], s["n"], F.length(s["d"])
    zeros = lambda count: F.repeat(F.lit("0"), count)
    head, tail = F.substring(d, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(d, 2, 99))).otherwise("")
    return (
        F.when((k <= n) & (n <= 21), F.concat(d, zeros(n - k)))
        .when((n > 0) & (n <= 21), F.concat(F.substr(d, F.lit(1), n), F.lit("."), F.substr(d, n + 1)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), zeros(-n), d))
        .otherwise(F.concat(head, tail, F.lit("e"), F.when(n >= 1, "+").otherwise("-"), F.abs(n - 1).cast("string")))
    )


def number_text(c: Column) -> Column:
    """A double as text: the shortest digits that read back as the same number, plain between 1e-6 and
    1e21, exponents as 1e-7 and 1.5e+21. Small whole numbers and what Java writes plainly with few
    digits take no more than a cast."""
    size = F.abs(c)
    sign = F.when(c < 0, "-").otherwise("")
    return (
        F.when(F.isnan(c), "NaN")
        .when(size == float("inf"), F.concat(sign, F.lit("Infinity")))
        .when((size < 1e15) & (c == F.rint(c)), c.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7) & (F.length(size.cast("string")) <= SURE_DIGITS + 1), c.cast("string"))
        .otherwise(F.concat(sign, let(shortest(size), laid_out)))
    )


def kind_of(data_type: T.DataType) -> str:
    if data_type == CELL:
        return MIXED
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMBER
    return NULL if isinstance(data_type, T.NullType) else STRING


@dataclass(frozen=True)
class Value:
    kind: str
    column: Column
    #: Whether a number column holds whole Spark numbers (their text needs no double).
    whole: bool = False
    #: The Python value, where it is a literal.
    literal: object = None

    @staticmethod
    def of(value: object) -> Value:
        """A literal; its Python type is its kind."""
        if value is None:
            return Value(NULL, F.lit(None).cast("string"))
        if isinstance(value, bool):
            return Value(BOOLEAN, F.lit(value), literal=value)
        if isinstance(value, (int, float)):
            return Value(NUMBER, F.lit(float(value)), literal=value)
        return Value(STRING, F.lit(str(value)), literal=str(value))

    @staticmethod
    def field(name: str, data_type: T.DataType) -> Value:
        c = F.col(f"`{name}`")
        kind = kind_of(data_type)
        if kind == STRING and not isinstance(data_type, T.StringType):
            c = c.cast("string")
        return Value(kind, c, isinstance(data_type, T.IntegralType))

    def pick(self, kind: str, mixed: str, spark: str) -> Column:
        if self.kind == kind:
            return self.column.cast(spark) if kind == NUMBER else self.column
        if self.kind == MIXED:
            return F.when(self.column["t"] == kind, self.column[mixed])
        return F.lit(None).cast(spark)

    @property
    def number(self) -> Column:
        """The number as a double, or null if the cell is none."""
        return self.pick(NUMBER, "n", "double")

    @property
    def string(self) -> Column:
        return self.pick(STRING, "s", "string")

    @property
    def boolean(self) -> Column:
        return self.pick(BOOLEAN, "b", "boolean")

    @property
    def is_null(self) -> Column:
        if self.kind == NULL:
            return F.lit(True)
        if self.kind == MIXED:
            return self.column.isNull() | self.column["t"].isNull()
        return self.column.isNull()

    @property
    def text(self) -> Column:
        """Text of the cell; null is the empty text."""
        if self.kind == STRING:
            return F.coalesce(self.column, F.lit(""))
        if self.kind == NULL:
            return F.lit("")
        if self.kind == BOOLEAN:
            return F.coalesce(self.column.cast("string"), F.lit(""))
        if self.kind == NUMBER:
            return F.coalesce(self.column.cast("string") if self.whole else number_text(self.number), F.lit(""))
        return F.coalesce(self.string, number_text(self.number), self.boolean.cast("string"), F.lit(""))

    @property
    def cell(self) -> Column:
        """As CELL, null for an empty one."""
        if self.kind == MIXED:
            return self.column
        if self.kind == NULL:
            return F.lit(None).cast(CELL)
        parts = [F.lit(self.kind).alias("t"), self.number.alias("n"), self.string.alias("s"), self.boolean.alias("b")]
        return F.when(self.column.isNotNull(), F.struct(*parts))

    def empty(self, mode: str) -> Column:
        """transform: null or ''; validate: null or a blank string."""
        s = self.string if mode == "transform" else js_trim(self.string)
        if self.kind in (NUMBER, BOOLEAN, NULL):
            return self.is_null
        return self.is_null | F.coalesce(s == "", F.lit(False))

    def same(self, other: Value) -> Column:
        """Equal kind and value; null equals null."""
        if self.kind == other.kind and self.kind not in (MIXED, NULL):
            if self.whole and other.whole:
                return self.column.eqNullSafe(other.column)
            a, b = (self.number, other.number) if self.kind == NUMBER else (self.column, other.column)
            return a.eqNullSafe(b)
        if MIXED in (self.kind, other.kind):
            return (self.is_null & other.is_null) | F.coalesce(self.cell.eqNullSafe(other.cell) & ~self.is_null, F.lit(False))
        return self.is_null & other.is_null

    @property
    def key(self) -> Column:
        """For grouping: equal for cells of equal kind and value."""
        return self.column

    @property
    def tag(self) -> Column:
        if self.kind == MIXED:
            return F.when(self.column.isNotNull(), self.column["t"])
        return F.when(~self.is_null, F.lit(self.kind))


def compared(a: Value, b: Value) -> Column:
    """-1, 0 or 1: by number if both are numbers, else by text in root collation order; nulls
    are dealt with by the caller."""
    m, n = a.number, b.number
    by_number = F.when(m < n, -1).when(m > n, 1).when(m == n, 0)
    if a.kind == b.kind == NUMBER:
        return by_number
    x, y = F.collate(a.text, "UNICODE"), F.collate(b.text, "UNICODE")
    by_text = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    mixed = MIXED in (a.kind, b.kind) or NULL in (a.kind, b.kind)
    return F.coalesce(by_number, by_text) if mixed else by_text


def unified(values: list[Value]) -> tuple[str, list[Column]]:
    """One kind for all values, and the columns cast to it."""
    kinds = {v.kind for v in values} - {NULL}
    if len(kinds) == 1:
        (kind,) = kinds
        if kind == NUMBER:
            return kind, [v.number if v.kind == NUMBER else F.lit(None).cast("double") for v in values]
        if kind == MIXED:
            return kind, [v.cell for v in values]
        spark = {STRING: "string", BOOLEAN: "boolean"}[kind]
        return kind, [v.column if v.kind == kind else F.lit(None).cast(spark) for v in values]
    if not kinds:
        return STRING, [F.lit(None).cast("string") for _ in values]
    return MIXED, [v.cell for v in values]
