"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.storage import materialize, new_path, shared_dir

__all__ = ["ascii_lower", "bucketed", "input_bytes", "materialize", "shared_dir", "table", "union_all"]

#: A-Z only, as the contracts ask; Spark's lower() would also change other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


#: Estimates above this are no statistics but what Spark takes where it has none.
UNKNOWN_BYTES = 1 << 47


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes that df reads, from Spark's own statistics; where it has none, those of its texts."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < UNKNOWN_BYTES else df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """df written to the shared folder in buckets of column, so that what is grouped or joined by
    it later need not be shuffled again. Each task writes a file for each bucket that it has."""
    spark = df.sparkSession
    entry, path = f"tablemill_{uuid.uuid4().hex}", new_path(spark, name)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(entry, format="parquet")
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # the entry alone: the files stay, and out reads them
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
