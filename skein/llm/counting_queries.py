"""Queries of the majority-vote sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.frequent_items import most_frequent
from skein.storage import read_table

FIELDS = ("called_name", "receiver_expr")


def p6_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent values with their counts; every count lies within the sketch's bounds."""
    calls = read_table(spark, sf_dir, "calls")
    parts = [most_frequent(calls.select(f), f).withColumn("field_name", F.lit(f)) for f in FIELDS]
    return parts[0].unionByName(parts[1]).select("field_name", "item_value", "n", (F.col("n").between(F.col("lower"), F.col("upper"))).alias("within_bounds"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_top_items(spark, sf_dir).select("field_name", "item_value")


_TOP = """
with c as (select 'called_name' field_name, called_name item_value, count(*) n from calls group by 2
  union all select 'receiver_expr', receiver_expr, count(*) from calls group by 2),
r as (select *, row_number() over (partition by field_name order by n desc, item_value) k from c where item_value <> '')
"""


def queries() -> dict:
    return {"p6_found": p6_found, "p6_top_items": p6_top_items}


def oracle_sql() -> dict:
    return {"p6_found": _TOP + "select field_name, item_value from r where k <= 20", "p6_top_items": _TOP + "select field_name, item_value, n, true within_bounds from r where k <= 20"}
