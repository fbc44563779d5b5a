"""Small tables for the corpus operators: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"
#: Names that operators use inside.
CLASHES = ("doc", "t", "spans", "score", "rep", "bucket", "items", "n_words", "row", "redacted", "ids", "decoded", "block", "kind", "h", "n")


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{int(words * r.random() ** 2)}" for _ in range(n))


def odd_texts() -> list[str | None]:
    base = prose(1, 120)
    long = prose(2, 30_000, 5_000)
    return [None, "", " \n\t ", "one", "a b c d", base, base, base + " end", base.replace("w3 ", "w5 ", 2), long, long + " tail", "x" * 200_000, "Mail a@b.com, c@d.org +1 555 123 4567 10.0.0.1"]


def docs_of(spark: SparkSession, texts: list[str | None], clash: bool = True, null_id: bool = True) -> DataFrame:
    """documents with those texts, ids from 1, one row of each repeated, one without an id."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    rows += [rows[5]] if len(rows) > 5 else []
    rows += [(None, texts[-1], None, None, None)] if null_id and texts else []
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES]) if clash else df


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space."""
    return [w.decode() for w in (text or "").encode().split()]


def lower(text: str | None) -> str:
    return (text or "").encode().lower().decode()
