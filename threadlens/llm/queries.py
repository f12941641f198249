"""Registered queries of the operators in this folder, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (archives, decontaminate, divergence, langid, lines, lmscore, minhash, mixing, packing,
                            quality, secrets, spelling, substrings)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Wished token weights of the domains the labels table tells apart.
MIX_WEIGHTS = {"good": 0.97, "low": 0.02, "toxic": 0.01}


def label_domain() -> Column:
    """The domain of a row of ``labels``: toxic, low quality or good; null if it is not labelled."""
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
            .when((F.col("quality") == 1) & (F.col("toxic") == 0), "good"))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label_domain(),
                        MIX_WEIGHTS)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(docs, model)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return lmscore.loss_differences(_table(spark, sf_dir, "documents"), good)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One edit for every ten characters, and at most two.
    return lines.line_duplicates(_table(spark, sf_dir, "documents"), tau=2, step=10)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(_table(spark, sf_dir, "pages"), min_payload=0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_soft_mixing, op2_quality_rules, op3_language_id, op4_lm_scoring, op5_secret_scan,
    op6_substring_dedup, op7_token_packing, op8_line_dedup, op9_benchmark_decontamination, op10_minhash_near_dedup,
    op11_warc, op12_spelling_variants, op13_source_divergence)}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.oracle(),
    "op6_substring_dedup": substrings.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
    "op11_warc": archives.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
