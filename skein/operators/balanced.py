"""Per-key results with evenly sized work, however few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.prefix_sum import number_rows
from skein.storage import Scratch


def balanced_key_stats(df: DataFrame, key: str, member: str, at: str, chunk_rows: int = 200_000) -> DataFrame:
    """Rows, distinct members, first and last time of each key by exact offset chunking.

    1. Each input partition reduces its (key, member) pairs before anything is shuffled (nothing per key is gathered), and
       the pairs are completed by hash of both, so a hot key is spread over its members.
    2. These states are put in one total order (key, member) and numbered through prefix-summed partition offsets, so a
       chunk is `chunk_rows` consecutive states: a hot key spans many chunks, many rare keys share one.
    3. Every chunk reduces its own states to one boundary state per key.
    4. Per key the chunk states are merged: a key has (its states / chunk_rows) + 2 of them at most.

    Null keys form one group; null members count as rows but not as members; null times are left out of first and
    last. An empty table gives no rows. Repeated rows count as rows. Columns: key_value, n_rows, n_members, first_at,
    last_at, n_chunks; columns of `df` other than the three named are not read.
    """
    scratch = Scratch(df.sparkSession)
    states = (
        df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{member}`").alias("m"), F.col(f"`{at}`").alias("t"))
        .groupBy("k", "m")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    )
    numbered = number_rows(states, ["k", "m"], "pos", scratch)
    chunked = numbered.withColumn("chunk", F.floor(F.col("pos") / chunk_rows))
    partial = chunked.groupBy("chunk", "k").agg(F.sum("n").alias("n"), F.count("m").alias("d"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return partial.groupBy(F.col("k").alias("key_value")).agg(
        F.sum("n").alias("n_rows"),
        F.sum("d").alias("n_members"),
        F.min("t0").alias("first_at"),
        F.max("t1").alias("last_at"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


def balanced_key_counts(df: DataFrame, key: str, chunk_rows: int = 200_000) -> DataFrame:
    """Rows of each key by exact offset chunking: key_value, n_rows, n_chunks.

    Each input partition counts its rows per key; the counts, in the order (key, partition), are prefix-summed to the row
    offsets that the rows would have in one sorted table; chunks are `chunk_rows` consecutive rows of it, and a count that
    reaches over a boundary is cut there. Chunks are summed each and merged per key. Null keys form one group; an empty
    table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    counts = df.select(F.col(f"`{key}`").alias("k"), F.spark_partition_id().alias("p")).groupBy("k", "p").agg(F.count(F.lit(1)).alias("n"))
    placed = number_rows(counts, ["k", "p"], "pos", scratch, weight="n")
    first, last = F.floor(F.col("pos") / chunk_rows), F.floor((F.col("pos") + F.col("n") - 1) / chunk_rows)
    cut = placed.select("k", "pos", "n", F.explode(F.sequence(first, last)).alias("chunk"))
    inside = F.least(F.col("pos") + F.col("n"), (F.col("chunk") + 1) * chunk_rows) - F.greatest(F.col("pos"), F.col("chunk") * chunk_rows)
    partial = cut.groupBy("chunk", "k").agg(F.sum(inside).alias("n"))
    return partial.groupBy(F.col("k").alias("key_value")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_chunks"))
