"""Normalised text on columns against its definition."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from tablemill.frame import from_dataframe
from tablemill.functions.normalized import normalize_text, normalized, tables
from tablemill.operators import profile


def both(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(8)
    got = {r.i: r.n for r in rows.select("i", normalized(F.col("t")).alias("n")).collect()}
    return [(t, got[i], None if t is None else normalize_text(t)) for i, t in enumerate(texts)]


def test_every_assigned_character(spark):
    """Alone, and between letters."""
    assigned = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    wrong = [x for x in both(spark, [f"{c} a{c}b" for c in assigned]) if x[1] != x[2]]
    assert len(assigned) > 140_000 and not wrong, (len(wrong), [(hex(ord(t[0])), a, b) for t, a, b in wrong[:8]])


ODD = [None, "", "  ", "Ａção №5", "ἄλφα", "Ệ", "ΑΣ ΑΣ' ΣΑΣ", "ΟΔΟΣ'Α", "각한글 값", "ﬁn ﷺ ㎏½", "Cod. Nº  Cliente_x", "ȩ́", "İstanbul", "straße", "DT-NASC", "日本語 がぎ", "\U00010400\U0001d400", "a" * 5000 + "é"]


def test_texts(spark):
    r = random.Random(2)
    pool = [0xE9, 0x3A3, 0xAC01, 0xFB01, 0x1E00, 0x300, 0x27, 0x20, 0x41, 0x3A, 0x4E00, 0x1F600, 0x2167]
    texts = ODD + ["".join(chr(r.choice([r.choice(pool), r.randrange(32, 127), r.randrange(0xA0, 0x2000)])) for _ in range(30)) for _ in range(500)]
    assert not [x for x in both(spark, texts) if x[1] != x[2]]


def test_tables_are_bounded():
    t = tables()
    assert len(t.one_from) < 15_000 and len(t.few) < 4_000 and len(t.many) < 500 and max(len(b) for _, b in t.many) <= 18


def test_search_beyond_latin(spark):
    f = from_dataframe(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k long, t string"), ["k"])
    for query, want in (("acao", [3]), ("ΆΛΦΑ", [4]), ("ệ", None), ("ΚΙΛΟ", []), ("한글", [8]), ("kg1", [9]), ("numero", None)):
        got = [r.k for r in profile.search(f, "t", query).sorted().select("k").collect()]
        expected = [i for i, t in enumerate(ODD) if normalize_text(query) in normalize_text(t or "")]
        assert got == expected and (want is None or got == want), query
