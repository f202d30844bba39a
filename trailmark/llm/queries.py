"""The operators as queries over the driver's tables, with the columns their contracts fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.llm.decontaminate import find_contamination
from trailmark.llm.line_dedup import dedup_runs
from trailmark.llm.mixing import mix_sources
from trailmark.llm.near_dedup import find_near_duplicates
from trailmark.llm.oracle import ORACLE
from trailmark.llm.periodic_runs import find_runs
from trailmark.llm.privacy import replace_entities
from trailmark.llm.quality import COUNTS, judge
from trailmark.llm.rule_ensemble import held_out as held_out_quality, score_quality
from trailmark.llm.substring_dedup import dedup_substrings
from trailmark.llm.suffix_dedup import dedup_bytes
from trailmark.llm.token_counts import count_tokens, read_vocabulary
from trailmark.llm.toxicity import held_out, score_toxicity
from trailmark.llm.whitening import whiten
from trailmark.sources.tables import read_table

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "text", *columns)


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = judge(texts(spark, folder, "lang", "source"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


@query
def op2_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for the personal data found in it."""
    replaced = replace_entities(texts(spark, folder), key="op2 query")
    return replaced.select(F.col("row.doc_id").alias("doc_id"), "n_entities", "text")


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words in every document, by FM-index."""
    found = find_contamination(texts(spark, folder), read_table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end_word - s.word)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram tokens of every document, counted only."""
    vocabulary = read_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    return count_tokens(texts(spark, folder), vocabulary).drop("text")


@query
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every document; its smallest id names it and stays."""
    judged = find_near_duplicates(texts(spark, folder))
    doc_id = F.when(~F.col("unknown"), F.col("key_id"))
    return judged.select(doc_id.alias("doc_id"), "class_id", "class_size", "kept")


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to passages of 50 words in documents of smaller ids."""
    return dedup_substrings(texts(spark, folder)).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_symbols").alias("n_words"),
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    scored = score_toxicity(texts(spark, folder), read_table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("segments").cast("bigint").alias("n_segments"),
    )


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to repeated runs of lines, and a digest of the rest."""
    result = dedup_runs(texts(spark, folder))
    return result.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed_chunks",
        "n_removed_lines",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, mixed so that a source counts by the square root of its size."""
    return mix_sources(read_table(spark, folder, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that occur twice."""
    return dedup_bytes(texts(spark, folder)).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("n_symbols").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def plant_repeats(docs: DataFrame) -> DataFrame:
    """The documents; in a tenth of them, by checksum of the id, the words from some place on repeat a few of them.

    With checksum h and g = h // 10, the text of an id with h % 10 = 0 has the same words up to word
    a = g % n and repeats the next 1 + (n - a) // (3 + g % 8) words from there to its end.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumns({"_h": checksum, "_w": F.when(checksum % 10 == 0, words)})
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    placed = chosen.withColumns({"_a": (g % F.greatest(n, F.lit(1))).cast("int"), "_n": n})
    period = F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)).cast("int")
    measured = placed.withColumn("_p", period)
    kept = F.slice("_w", F.lit(1), F.col("_a"))
    repeated = F.transform(
        F.sequence(F.col("_a"), F.greatest(F.col("_n") - 1, F.col("_a"))),
        lambda i: F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")),
    )
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(kept, repeated), " ")).otherwise(F.col("text"))
    return measured.withColumn("text", text).select(*docs.columns)


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, the longest one, and digests of all and of what is left."""
    found = find_runs(plant_repeats(texts(spark, folder)))
    order = F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period, r.start, r.period))
    longest = found.withColumn("longest", F.array_max(order))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return longest.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(F.col("longest.length") * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by weighted rules, learned from the labels that are not held out."""
    scored = score_quality(texts(spark, folder), read_table(spark, folder, "labels"))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out_quality(F.col("row.doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the four principal components, whitened."""
    whitened = whiten(read_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return whitened.select(
        F.col("row.vec_id").alias("vec_id"),
        "component",
        "n",
        "deviation",
        "whitened",
        "explained",
        "identity_error",
    )
