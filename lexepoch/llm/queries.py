"""The registered query of each training-data operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cdc, cws, exactdedup, mixing, packing, pieces, pii, resampling, simhash, spelling, tokens, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeated_passages(_read(spark, sf_dir, "documents"), inside=True)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints_and_edits(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(_read(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.filter_urls(urlfilter.captures_of(pages), urlfilter.list_of(pages))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), k=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_url_filters": op6_url_filters,
    "op7_toxicity": op7_toxicity,
    "op8_source_mixing": op8_source_mixing,
    "op9_personal_data": op9_personal_data,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLE: dict[str, str] = {"op4_exact_dedup": exactdedup.ORACLE, "op6_url_filters": urlfilter.ORACLE, "op11_spelling_variants": spelling.ORACLE,
                          "op12_importance_resampling": resampling.ORACLE}
