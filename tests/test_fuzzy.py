"""Fuzzy keys against the scores of all pairs."""

from __future__ import annotations

import random

import pytest

from tablemill.frame import FrameError
from tablemill.functions.normalized import normalize_text
from tablemill.operators.fuzzy import best_match, fuzzy_keys
from tablemill.operators.mapping import similarity


def noisy(r, text):
    letters, words = list(text), text.split()
    match r.randrange(6):
        case 0:
            letters[r.randrange(len(letters))] = r.choice("abxyz ")
            return "".join(letters)
        case 1:
            r.shuffle(words)
            return " ".join(words)
        case 2:
            return text.upper() + r.choice(["", " Nº", "!", " x"])
        case 3:
            return text.replace("e", "é")
        case 4:
            return " ".join(words[1:]) or text
    return text


def all_pairs(left, right, least):
    names = lambda side: {v: normalize_text(v) for v in side if v is not None and normalize_text(v)}
    a, b = names(left), names(right)
    return sorted((x, y, s) for x in a for y in b if (s := similarity(a[x], b[y])) >= least)


def table_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")


@pytest.mark.parametrize("least", [0.85, 0.7, 1.0])
def test_all_pairs_of_part_names(spark, least):
    r = random.Random(5)
    names = [x.p_name for x in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").orderBy("p_partkey").collect()]
    left = names + [f"{x} {r.choice(['de', 'the', 'of'])} {y}" for x, y in zip(names, names[7:])]
    right = [noisy(r, t) for t in left] + [None, "", "--", "Ａção", "ACAO", left[0]] + [left[1]] * 500
    left += [None, "!", "ação", "cod", "codigo"]
    got = fuzzy_keys(table_of(spark, left).repartition(3), table_of(spark, right), "t", least=least)
    assert sorted(map(tuple, got.collect())) == all_pairs(set(left), set(right), least)


def test_best_match_and_bounds(spark):
    m = fuzzy_keys(table_of(spark, ["data nascimento", "valor"]), table_of(spark, ["dt nasc", "data nascimento x", "Data Nascimento", "valores"]), "t")
    assert [(x.left, x.right, x.score) for x in best_match(m).collect()] == [("data nascimento", "Data Nascimento", 1.0)]
    assert fuzzy_keys(table_of(spark, []), table_of(spark, ["a"]), "t").count() == 0
    with pytest.raises(FrameError):
        fuzzy_keys(table_of(spark, ["a"]), table_of(spark, ["a"]), "t", least=0.6)
