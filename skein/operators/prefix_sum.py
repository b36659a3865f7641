"""Distributed prefix sums: offsets of a total order without a window over one group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skein.storage import Scratch, shuffle_partitions


def number_rows(df: DataFrame, order: list[str], position: str, scratch: Scratch, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Adds `position`, the row's place (from 0) in the total order of the columns `order`.

    Rows are range-partitioned and sorted, each partition numbers its own rows, and the partitions' row counts are
    prefix-summed on the driver: one number per partition, however many rows there are. Ties are numbered in any order.
    The sorted table is written once, so that counting and numbering see the same ranges. An empty input stays empty.
    With `weight`, a column of whole numbers that are not null, a row takes up that many places and `position` is its first.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    cols = [F.col(f"`{c}`") for c in order]
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_at", at)
    if weight is not None:
        ranged = ranged.mapInArrow(_running(weight), StructType([*ranged.schema.fields, StructField("_run", LongType())]))
    saved = scratch.save(ranged)
    part = F.shiftright("_at", 33)
    sizes = saved.groupBy(part.alias("_part")).agg((F.count(F.lit(1)) if weight is None else F.sum(f"`{weight}`")).alias("count")).collect()
    offsets, total = {}, 0
    for row in sorted(sizes, key=lambda r: r[0]):
        offsets[row[0]] = total
        total += row[1]
    spark = df.sparkSession
    table = spark.createDataFrame([(int(k), int(v)) for k, v in offsets.items()], "_part long, _base long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) if weight is None else F.col("_run")
    return (
        saved.withColumn("_part", part)
        .join(F.broadcast(table), "_part")  # one row per partition
        .withColumn(position, F.col("_base") + within)
        .drop("_part", "_base", "_at", "_run")
    )


def _running(weight: str):
    """Adds the sum of the weights of the rows before, in the partition's order."""

    def run(batches):
        before = 0
        for batch in batches:
            w = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = before + np.cumsum(w)
            before = int(sums[-1]) if len(sums) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - w)], [*batch.schema.names, "_run"])

    return run
