"""The queries opN_<name> over the `documents` table of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import oracle


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=3, num=85, den=100)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.fingerprint import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.pii import KINDS, find_pii, joined, train

    docs = documents(spark, sf_dir)
    base = F.filter("spans", lambda s: s["base"])
    found = find_pii(docs, train(docs)).withColumn("base", base)
    counts = [number_of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.substring import drop_repeats

    return drop_repeats(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir), contained=0.8)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.tokens import token_counts

    return token_counts(documents(spark, sf_dir), limit=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality import apply_policy, ledger

    led = apply_policy(ledger(documents(spark, sf_dir)), "base").withColumn("base_failed", ~F.col("kept"))
    return apply_policy(led, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality import ablations, ledger

    return ablations(ledger(documents(spark, sf_dir)), "v1")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.packing import pack

    return pack(documents(spark, sf_dir), capacity=2048)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_fingerprints, op3_personal_data, op4_repeated_passages, op5_license_scan, op6_token_counts, op7_toxicity, op8_quality_ledger, op9_best_fit_packing, op10_source_mix, quality_ablations)}
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
