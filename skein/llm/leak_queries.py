"""Queries over leaked evaluation texts. SQL has no such search; tests compare with brute force over all alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.leaks import leaked_passages, removal_spans
from skein.storage import read_table


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word spans to remove from each document, with the items they come from."""
    return removal_spans(_found(spark, sf_dir))


def queries() -> dict:
    return {"p9_found": p9_found, "p9_spans": p9_spans}


def oracle_sql() -> dict:
    return {}
