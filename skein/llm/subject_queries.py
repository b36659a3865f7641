"""Queries over subject areas. A learnt classifier has no SQL; tests measure it on held-out labels and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.subjects import document_subjects
from skein.storage import read_table


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(*(read_table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences per subject over the whole corpus."""
    found = _found(spark, sf_dir)
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


def queries() -> dict:
    return {"p10_found": p10_found, "p10_composition": p10_composition}


def oracle_sql() -> dict:
    return {}
