"""One query per operator over its whole table, and the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, exact_dedup, fill_middle, html_content, importance, license_scan, line_dedup, mixing, packing, pii, quality, simhash,
    token_counts,
)
from .common import reach_workers

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(spark, _table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(spark, _table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, _table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(spark, _table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(spark, _table(spark, sf_dir, "documents"))


def op9_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.main_texts(spark, _table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(spark, _table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance.importance_ranks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return ranks.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    found = [
        op1_mix, op2_license_scan, op3_exact_dedup, op4_quality, op5_pii, op6_token_counts, op7_simhash,
        op8_line_dedup, op9_html_content, op10_decontaminate, op11_pack, op12_fill_middle, op13_importance,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
