"""References to records that do not exist, from signed counts per key and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.lookup import lookup_join


def orphan_keys(refs: DataFrame, records: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, key, month) whose references have no live record at the end of that month, with the reason.

    refs: scope columns, key, month (int), n (signed count of references). records: scope columns, key, since, until
    (months; since null: never live; until null: not deleted). A record is live at the end of the months since .. until-1.

    Both sides become signed deltas: +n references in their month, +1 existence in `since`, -1 in `until`. They are
    summed per key and month before any window, so a window holds one row per month of a key. A running sum of the
    existence deltas then says how many records are live. reason: missing (no record at all), late (all records begin
    after the month), else deleted. Null keys are no references.
    """
    return orphans_of(reference_deltas(refs, records, scope), scope)


def reference_deltas(refs: DataFrame, records: DataFrame, scope: list[str]) -> DataFrame:
    """scope, key, month, exist, refs, rows: the signed counts of `orphan_keys`, one row per key and month. Deltas of two
    batches can be added up by `merge_deltas`, so a maintained state is never built again from all rows."""
    keys = [*scope, "key"]
    zero = F.lit(0).cast("long")
    base = records.where(F.col("key").isNotNull())
    begins = base.select(*keys, F.coalesce("since", F.lit(-1)).alias("month"), F.when((F.col("until") <= F.col("since")) | F.col("since").isNull(), 0).otherwise(1).cast("long").alias("exist"), zero.alias("refs"), F.lit(1).cast("long").alias("rows"))
    ends = base.where(F.col("until") > F.col("since")).select(*keys, F.col("until").alias("month"), F.lit(-1).cast("long").alias("exist"), zero.alias("refs"), zero.alias("rows"))
    wanted = refs.where(F.col("key").isNotNull() & F.col("month").isNotNull()).select(*keys, "month", zero.alias("exist"), F.col("n").cast("long").alias("refs"), zero.alias("rows"))
    return _added(begins.unionByName(ends).unionByName(wanted), keys)


def _added(deltas: DataFrame, keys: list[str]) -> DataFrame:
    return deltas.groupBy(*keys, "month").agg(F.sum("exist").alias("exist"), F.sum("refs").alias("refs"), F.sum("rows").alias("rows"))


def merge_deltas(state: DataFrame, change: DataFrame, scope: list[str]) -> DataFrame:
    """The state after a batch of changes, whose counts may be negative (a reference or record taken back); keys and months
    that come to nothing are dropped."""
    return _added(state.unionByName(change), [*scope, "key"]).where("exist <> 0 or refs <> 0 or rows <> 0")


def orphans_of(deltas: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, key, month, refs, reason) of the orphans that a state of deltas has."""
    keys = [*scope, "key"]
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    counted = deltas.select(
        *keys, "month", "refs",
        F.sum("exist").over(running).alias("live"),
        F.sum("rows").over(by_key).alias("all_rows"),
        F.min(F.when(F.col("rows") > 0, F.col("month"))).over(by_key).alias("first"),
    )
    reason = F.when(F.col("all_rows") == 0, "missing").when(F.col("first") > F.col("month"), "late").otherwise("deleted")
    return counted.where((F.col("refs") > 0) & (F.col("live") <= 0)).select(*keys, "month", "refs", reason.alias("reason"))


def orphan_rows(refs: DataFrame, orphans: DataFrame, scope: list[str]) -> DataFrame:
    """The rows of refs (scope, key, month and any payload) that are orphans, with the reason; hot keys are split off.
    A payload column named reason gives way to the result's."""
    refs = refs.drop("reason")
    found = orphans.select(*scope, "key", "month", "reason")
    return lookup_join(refs.where(F.col("key").isNotNull() & F.col("month").isNotNull()), found, [*scope, "key", "month"], "inner")
