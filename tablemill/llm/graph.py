"""Connected components by label propagation with pointer jumping, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links: root is the smallest node that it is connected
    with. Each round takes the smallest root among neighbours and then follows roots once
    more, so long chains halve. Labels are written out after each round, since they are the
    input of the next; nothing is collected but whether a label changed."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = materialize(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c"))
    labels = materialize(labels.select(F.col("u").alias("node"), F.col("c").alias("root")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = step.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old")
        step = materialize(step, "labels")
        labels = step.select("node", "root")
        if step.where("root <> old").limit(1).isEmpty():
            return labels
