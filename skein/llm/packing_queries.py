"""Queries of container packing. Packing is an algorithm, not a relation: tests check placement, capacity, conflicts
and fill instead of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.packing import pack_documents
from skein.storage import read_table


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of capacity in use per size."""
    placed = p8_containers(spark, sf_dir)
    sizes = read_table(spark, sf_dir, "pack_sizes").select("pack_name", F.col("capacity_tokens").alias("capacity")).distinct()
    per = placed.groupBy("pack_name").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(sizes, "pack_name").select("pack_name", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))


def queries() -> dict:
    return {"p8_containers": p8_containers, "p8_fill": p8_fill}


def oracle_sql() -> dict:
    return {}
