"""The registered corpus queries: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import audio, centroids, contamination, hosts, lexical, nearcopies, passages, personal, pieces, quality, replies, scoring, wordbpe
from tablemill.llm.common import materialize, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal.find(docs, personal.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    count = [F.size(F.array_remove(kinds, k)).cast("long") for k in personal.KINDS]
    count = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for n, k in zip(count, personal.KINDS)]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *count, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `conversations`, which quotes nothing, and with it the conversations that `quoting`
    makes of all of it: replies that quote at two levels, inside a conversation and across."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = replies.threads(messages.unionByName(replies.quoting(messages)))
    own = F.sha2(F.coalesce("own_text", F.lit("")), 256).alias("own_sha256")
    return out.select("conv_id", "turn", "role", own, "n_quoted", "n_linked", "max_level", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth")


def op3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the quality in `labels` under its id."""
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def held_out(fold: int, of: int, doc: str = "doc_id") -> Column:
    return F.crc32(F.col(doc).cast("string").cast("binary")) % of == fold


#: Rows whose score is lower are rejected.
LEAST_QUALITY = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(0, 5))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.find(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearcopies.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(table(spark, sf_dir, "documents"), learn=~held_out(2, 7))
    return scored.select("doc_id", held_out(2, 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), piece_model(), decode=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are rendered from `embeddings`, the only table of signals. Queries are the ids
    divisible by 20. Every row has its class (the smallest id of equal fingerprints); a query has
    one row for each class that matches it, its own among them if other ids are in that, and how
    many those are. Rows that are no queries, and queries without a match, have one row."""
    prints = materialize(audio.fingerprints(audio.rendered(table(spark, sf_dir, "embeddings")), "vec_id", "audio"), "prints")
    is_query = F.col("vec_id") % 20 == 0
    found = materialize(audio.search(prints, prints.where(is_query), "vec_id"), "matches")
    counts = found.groupBy("query").agg(F.count(F.lit(1)).alias("n_matches"))
    found = found.join(counts, "query").withColumn("asked", F.lit(True))
    members = prints.join(audio.classes(prints, "vec_id"), "prints", "left").withColumn("asked", is_query)
    named = members.join(found.withColumnRenamed("query", "rep"), ["rep", "asked"], "left")
    return named.select(
        "vec_id",
        (F.octet_length("prints") / 4).cast("long").alias("n_prints"),
        F.sha2("prints", 256).alias("prints_sha256"),
        F.col("rep").alias("class_id"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("match").alias("match_id"),
        F.col("offset").alias("match_offset"),
        F.col("error").alias("bit_error"),
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    named = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wordbpe.encode(table(spark, sf_dir, "documents"), word_vocabulary(), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n, total = lexical.statistics(docs)
    lists = materialize(lexical.index(docs, n, total), "index")
    return lexical.search(lists, table(spark, sf_dir, "benchmark"), n, total).withColumnRenamed("doc", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal": op1_personal,
    "op2_replies": op2_replies,
    "op3_hosts": op3_hosts,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_passages": op6_passages,
    "op7_near_copies": op7_near_copies,
    "op8_language_model": op8_language_model,
    "op9_pieces": op9_pieces,
    "op10_audio": op10_audio,
    "op11_clusters": op11_clusters,
    "op12_words": op12_words,
    "op13_search": op13_search,
}
ORACLE_SQL: dict[str, str] = {"op2_replies": replies.SQL, "op3_hosts": hosts.SQL, "op11_clusters": centroids.sql(), "op13_search": lexical.SQL}
