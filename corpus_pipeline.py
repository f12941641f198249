"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing and packing, in that order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``docs``, in their order; extra columns go along
whatever their names. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, langid, minhash, mixing, packing
from threadlens.llm.queries import MIX_WEIGHTS, label_domain
from threadlens.session import cut_lineage

# A text is rejected if it has no letter, or if no language holds even this share of its words.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, or without any leading language, go.

    Null and empty texts go; a row with a null id is judged by its text; repeated rows are judged alike; where two
    languages tie, the alphabetically first one leads. Without any labelled row every text is unknown and goes.
    """
    judged = langid.predict_rows(docs, langid.fit(docs))
    return (judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
            .select("row.*"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates on five-word shingles at 0.8: the smallest id of each group stays.

    Rows without a word and rows with a null id stay; where ids repeat, a row is known by id and text, and one of
    several equal rows stays.
    """
    return minhash.distinct_rows(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold four fifths of a benchmark item's five-word shingles go.

    Null and empty texts hold nothing and stay; copies of a text go together, whatever their ids; null and empty items
    match nothing, an item under five words is one run of all its words; an empty benchmark removes nothing.
    """
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that meet the domains' target weights; each text stays as often as its rate, a fraction by a hash.

    Null and empty texts have no token and the rate of their posterior; rows equal in id and text share one draw;
    labels of unknown texts and null labels are not used, and without any label every row stays once.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_rows(docs, labels, label_domain(), MIX_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows, with segment lengths, position resets and the ids of the texts.

    Null and empty texts are in no row; a row that stands several times is packed as often; a null id stands as null.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
