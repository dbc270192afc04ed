"""The ten operators with their production parameters over their whole tables."""
from __future__ import annotations

__all__ = ["oracle_sql", "queries"]

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup
from .decontaminate import leaks
from .license_scan import scan
from .minhash_dedup import near_duplicates
from .ngram_lm import score_held_out
from .oracles import oracle_sql
from .packing import pack
from .quality_cnn import classify
from .quality_rules import apply_rules
from .substring_dedup import remove_repeats
from .token_counts import count_tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_lines(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(_read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_words", "changed_slots")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), size=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_quality_rules, op4_decontamination, op5_substring_dedup, op6_license_scan, op7_near_duplicates, op8_packing, op9_quality_classifier, op10_lm_scoring)}
