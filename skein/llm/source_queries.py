"""Queries over source files. SQL cannot parse programming languages, so none is given; tests compare with Python's
own parser, with hand-written cases and with the indexed functions of the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.function_docs import function_documentation
from skein.llm.source_files import invalid_files, invalid_rates
from skein.storage import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_documentation(read_table(spark, sf_dir, "files")).select("rel_path", "qualified_name", "start_line").distinct()


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-description pairs: where the function is, its parameters and its documentation."""
    return function_documentation(read_table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(read_table(spark, sf_dir, "files")).select("rel_path")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(read_table(spark, sf_dir, "files"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(read_table(spark, sf_dir, "files"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_pairs": p1_pairs, "p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates}


def oracle_sql() -> dict:
    return {}
