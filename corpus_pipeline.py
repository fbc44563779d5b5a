"""The corpus pipeline: five stages over `documents`, each the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm.common import materialize, table
from tablemill.llm.stages import decontaminate, encode_pieces, filter_quality, keep_one_of_each, redact

STAGES = [
    ("quality classifier", filter_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The trained and hashed stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
