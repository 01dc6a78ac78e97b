"""The thin queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.llm import common as C
from fusewright.llm import decontaminate, fingerprint, html, jaccard, language, oracle, repeats, suffixes, tokens, toxicity


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(C.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.phrase_matches(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.near_matches(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_near", F.array_join("near_items", ",").alias("near_items"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = C.crc32_mod("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.substring_dedup(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(C.table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.suffix_dedup(docs, length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.crc32_mod("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), C.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attribute_tokens(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_edits(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(C.table(spark, sf_dir, "documents").select("doc_id", "text"), size=4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_html_extraction, op2_decontamination, op2_proximity, op3_language_id, op4_substring_dedup, op5_ngram_jaccard, op6_suffix_dedup, op7_toxicity, op8_token_counts, op9_fingerprints, op10_best_fit_packing]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
