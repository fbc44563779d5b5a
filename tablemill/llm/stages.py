"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all rows of
docs; all but the last return the columns of docs.

Defined cases: as in the operators. A text that is null or empty is scored like any other,
is nobody's copy, is never contaminated, has nothing to redact and encodes to begin and end;
repeated rows are treated alike; empty tables pass through empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import contamination, nearcopies, personal, pieces, quality
from tablemill.llm.common import table
from tablemill.llm.queries import LEAST_QUALITY, held_out, piece_model


#: Documents this alike are copies, where no contract says otherwise.
NEAR = 0.8


def rows_of(docs: DataFrame, without: str | None = None) -> DataFrame:
    """text, and all columns (or all but one) as one struct `row`: no name of theirs can clash
    with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("row"), "text")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under LEAST_QUALITY."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(0, 5))
    return quality.score(rows_of(docs), machine, keep=("row",)).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each component of near-copies: of five-word shingles with a
    similarity of NEAR or more, and of what such links connect."""
    copies = nearcopies.find(docs, threshold=NEAR).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = contamination.find(rows_of(docs), table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.where(F.size("spans") == 0).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind; n_chars follows."""
    found = personal.find(rows_of(docs, without="text"), personal.train(docs), keep=("row",), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids (little-endian unsigned 32-bit integers), their number, and whether they
    decode to the text."""
    out = pieces.encode(docs, piece_model(), keep=("doc_id", "text"), decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))
