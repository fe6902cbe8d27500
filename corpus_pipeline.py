"""From raw documents to packed sequences: five stages, each one operator.

Each stage takes what the one before it kept, written as Parquet in between,
and returns the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinedge.llm import decontaminate, language, lines, neardup, packing
from twinedge.scratch import materialise
from twinedge.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go.

    Null, empty and blank texts have no language and go; a null doc_id stays.
    Repeated rows go or stay together. Without any labelled row nothing is known
    of languages, and every document with a word stays.
    """
    ship(spark)
    return language.with_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so does a document of which nothing else is left.

    Null and empty texts have no lines and stay. Rows with equal doc_id and text
    keep the same lines. ``n_chars``, if there is such a column, follows the text.
    """
    ship(spark)
    found = lines.deduplicated(docs).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length)
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the
    smallest doc_id; texts without words and null ids stay."""
    ship(spark)
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts and null
    ids stay, and all documents do if there are no items."""
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; a null or empty text is its end id alone, repeated rows
    are packed as often as they stand there."""
    ship(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
