"""Values of two columns that name the same thing, by the likeness that headers are matched with.

The likeness is NAME_WEIGHT times Jaro-Winkler plus TOKEN_WEIGHT times Dice of the words. Since Jaro-Winkler is at
most 1, a pair that reaches the threshold has a Dice of at least D; so this is a join of word sets. Words
are ordered by how rare they are; two sets that overlap enough share one of their first words (as many
as the threshold leaves), so only those meet. Of pairs that do, sizes and places of the shared word bound the
overlap, and then lengths and first letters bound Jaro-Winkler, before a pair gets its exact score.

Distinct normalised names are joined, not rows, so a name that a third of all rows have is one. Nothing
is compared with everything, and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.frame import FrameError
from tablemill.functions.normalized import normalized
from tablemill.functions.storage import materialize
from tablemill.operators.mapping import HIGH, NAME_WEIGHT, TOKEN_WEIGHT, similarity

#: Scores are rounded to four places.
ROUNDING = 0.00005 + 1e-9
#: Letters that Jaro-Winkler rewards at the start, and by how much each.
FIRST_LETTERS, REWARD = 4, 0.1


def least_dice(least: float) -> float:
    d = (least - ROUNDING - NAME_WEIGHT) / TOKEN_WEIGHT
    if d <= 0:
        raise FrameError(f"O limite de semelhança deve ser maior que {NAME_WEIGHT}.")
    return d


def named(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of the column and their normalised names; values without letters or numbers are left out."""
    rows = df.select(F.col(f"`{column}`").cast("string").alias("value")).distinct()
    return rows.withColumn("name", normalized(F.col("value"))).where("name <> ''")


def with_first_words(names: DataFrame, rarity: DataFrame, d: float) -> DataFrame:
    """name, its `words` from rare to common and `first`, those of which a match must share one."""
    words = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).join(rarity, "word")
    out = words.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "word")))["word"].alias("words"))
    size = F.size("words")
    # both share at least so many words
    overlap = F.ceil(size * (d / (2 - d)) - 1e-9)
    return out.withColumn("first", F.slice("words", F.lit(1), F.greatest(size - overlap + 1, F.lit(1)).cast("int")))


def highest_name_score(a: Column, b: Column) -> Column:
    """What Jaro-Winkler is at most: all letters of the shorter name match in order, and the first letters are known."""
    la, lb = F.length(a), F.length(b)
    short = F.least(la, lb)
    jaro = (short / la + short / lb + 1) / 3
    alike = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, FIRST_LETTERS + 1)]
    same = sum([F.when(x & (short >= k), 1).otherwise(0) for k, x in enumerate(alike, 1)], F.lit(0))
    return jaro + same * REWARD * (1 - jaro)


def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        pairs["score"] = [similarity(a, b) for a, b in zip(pairs["a"], pairs["b"])]
        yield pairs


def fuzzy_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of normalised names and their `score`, complete from `least` on."""
    d = least_dice(least)
    words = left.select("name").unionByName(right.select("name")).select(F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    rarity = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sides = []
    for names, s in ((left, "a"), (right, "b")):
        df = with_first_words(names.select("name").distinct(), rarity, d)
        sides.append(df.select(F.col("name").alias(s), F.col("words").alias(f"{s}_words"), F.col("first").alias(f"{s}_first"), F.posexplode("first").alias(f"{s}_at", "word")))
    na, nb = F.size("a_words"), F.size("b_words")
    need = F.ceil(d / 2 * (na + nb) - 1e-9)
    within = F.least("a_at", "b_at") + 1 + F.least(na - F.col("a_at"), nb - F.col("b_at")) - 1
    met = sides[0].join(sides[1], "word").where(within >= need)
    # a pair that shares several first words is taken at the rarest
    met = met.where(F.array_intersect("a_first", "b_first")[0] == F.col("word"))
    dice = 2 * F.size(F.array_intersect("a_words", "b_words")) / (na + nb)
    bound = NAME_WEIGHT * highest_name_score(F.col("a"), F.col("b")) + TOKEN_WEIGHT * dice
    pairs = met.where(bound >= least - ROUNDING).select("a", "b")
    return pairs.mapInPandas(scored, "a string, b string, score double").where(F.col("score") >= least)


def fuzzy_keys(left: DataFrame, right: DataFrame, left_column: str, right_column: str | None = None, least: float = HIGH) -> DataFrame:
    """(left, right, score) for all distinct values of both columns whose likeness is at least `least`. Null and
    what holds no letters or numbers is like nothing."""
    a, b = (materialize(named(df, c), "names") for df, c in ((left, left_column), (right, right_column or left_column)))
    pairs = fuzzy_names(a, b, least)
    sides = [side.select(F.col("name").alias(s), F.col("value").alias(n)) for side, s, n in ((a, "a", "left"), (b, "b", "right"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("left", "right", "score")


def best_match(matches: DataFrame) -> DataFrame:
    """For each left value the likeliest right one, the first in text order of equals."""
    return matches.groupBy("left").agg(F.min_by(F.struct("right", "score"), F.struct(-F.col("score"), F.col("right"))).alias("m")).select("left", "m.right", "m.score")


