"""Differences between consecutive full snapshots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import Scratch, bounded, shuffle_partitions

CHANGES = np.array(["added", "removed", "changed"])


def diff_arrays(table: pa.Table) -> pa.Table:
    """Compares each snapshot of one hash bucket with the one before it.

    Columns g (group hash), ord (snapshot number in its group), k and k2 (two hashes of the key), c (hash of the
    content, 0: unknown) and v (hash of the weaker attributes). Works on sorted integer arrays: a key becomes its rank
    among the bucket's keys, a snapshot its rank among (g, ord), and membership of (snapshot, key) is a binary search.
    """
    g, o, k, k2, c, v = (table.column(n).to_numpy() for n in ("g", "ord", "k", "k2", "c", "v"))
    if not len(g):
        return _rows(g, o, k, k2, np.zeros(0, int))
    order = np.lexsort((v, c, k2, k, o, g))
    g, o, k, k2, c, v = (x[order] for x in (g, o, k, k2, c, v))
    last = np.ones(len(g), bool)  # of repeated keys in one snapshot the greatest row stays
    last[:-1] = (g[1:] != g[:-1]) | (o[1:] != o[:-1]) | (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    g, o, k, k2, c, v = (x[last] for x in (g, o, k, k2, c, v))
    by_key = np.lexsort((k2, k, g))
    new = np.ones(len(g), bool)
    new[1:] = (g[by_key][1:] != g[by_key][:-1]) | (k[by_key][1:] != k[by_key][:-1]) | (k2[by_key][1:] != k2[by_key][:-1])
    rank = np.empty(len(g), np.int64)
    rank[by_key] = np.cumsum(new) - 1
    # Rows are in (g, ord, key hash) order; (ord, rank) is unique, as a rank belongs to one group.
    width = int(o.max()) + 2
    code = rank * width + o
    sort = np.argsort(code)
    codes = code[sort]

    def find(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(codes, wanted)
        at[at == len(codes)] = 0
        return np.where(codes[at] == wanted, sort[at], -1)

    before, after = find(code - 1), find(code + 1)
    before[o == 0] = -1
    added = np.flatnonzero((before < 0) & (o > 0))
    removed = np.flatnonzero((after < 0) & (table.column("last_ord").to_numpy()[order][last] > o))
    both = np.flatnonzero(before >= 0)
    p = before[both]
    known = (c[both] != 0) & (c[p] != 0)
    changed = both[np.where(known, c[both] != c[p], v[both] != v[p])]
    rows = np.concatenate([added, removed, changed])
    kinds = np.repeat([0, 1, 2], [len(added), len(removed), len(changed)])
    return _rows(g[rows], o[rows], k[rows], k2[rows], kinds)


def _rows(g, o, k, k2, kinds) -> pa.Table:
    return pa.table({"g": pa.array(g, pa.int64()), "ord": pa.array(o, pa.int32()), "k": pa.array(k, pa.int64()), "k2": pa.array(k2, pa.int32()), "change": pa.array(CHANGES[kinds], pa.string())})


def snapshot_changes(snapshots: DataFrame, group: list[str], at: str, delivered: str, entries: str, key, content, weak: list, bucket_rows: int = 1_000_000) -> DataFrame:
    """Keys added, removed or changed from each snapshot of a group to the next.

    snapshots: one row per delivery, `entries` a map from key to struct. `key` maps the key column to its canonical form,
    `content` the value column to a content hash in canonical form (null or '' if unknown), `weak` names the value's
    fields that are compared where a content hash is missing on either side. A snapshot is (group, at), however often it
    is delivered; the latest delivery counts. Deliveries with a null `at` or a null map are left out; null group
    columns form a group of their own. An empty map is a snapshot with no keys. An empty table gives no rows.

    Only hashes are shuffled, in evenly filled buckets by hash of group and key, and sorted and compared in numpy
    (`diff_arrays`); the full keys are then looked up for the differing hashes only.
    Columns: the group columns, `at` (of the later snapshot), key, change.
    """
    spark = snapshots.sparkSession
    names = [f"g{i}" for i in range(len(group))]
    raw = snapshots.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(group, names)], F.col(f"`{at}`").alias("at"), F.col(f"`{delivered}`").alias("dl"), F.col(f"`{entries}`").alias("files")).where(F.col("at").isNotNull() & F.col("files").isNotNull())
    of_group = Window.partitionBy(*names)
    index = (
        raw.groupBy(*names, "at").agg(F.max("dl").alias("dl"))
        .withColumn("ord", (F.row_number().over(of_group.orderBy("at")) - 1).cast("int"))
        .withColumn("last_ord", (F.count(F.lit(1)).over(of_group) - 1).cast("int"))
    )
    right = index.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("at").alias("_at"), F.col("dl").alias("_dl"), "ord", "last_ord")
    same = F.col("at") == F.col("_at")
    for n in [*names, "dl"]:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    chosen = raw.join(F.broadcast(right) if bounded(right, 200_000) else right, same).select(*names, "at", "ord", "last_ord", "files")
    g = F.xxhash64(F.lit(7), *names)
    each = chosen.select(*names, "at", g.alias("g"), "ord", "last_ord", F.explode("files").alias("_key", "_value"))
    hashed = F.xxhash64(F.lower(content(F.col("_value"))))
    unknown = F.coalesce(content(F.col("_value")) == "", F.lit(True))
    each = each.withColumn("key", key(F.col("_key"))).select(
        *names, "at", "g", "ord", "last_ord", "key", F.xxhash64("key").alias("k"), F.hash("key").alias("k2"),
        F.when(unknown, 0).when(hashed == 0, 1).otherwise(hashed).cast("long").alias("c"),
        F.xxhash64(*[F.col("_value")[w] for w in weak]).alias("v"),
    )
    total = raw.select(F.sum(F.size("files"))).collect()[0][0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // bucket_rows))
    compact = each.select(F.pmod(F.xxhash64("g", "k"), F.lit(buckets)).alias("b"), "g", "ord", "last_ord", "k", "k2", "c", "v")
    differing = compact.groupBy("b").applyInArrow(diff_arrays, "g long, ord int, k long, k2 int, change string")
    differing = Scratch(spark).save(differing)
    # Full keys are read for differing hashes only: where these are few they go to the keys, else both are shuffled. A
    # removed key is read from the earlier snapshot, the others from the later one.
    keys = each.select("g", "ord", "k", "k2", "key")
    found = keys.join(F.broadcast(differing) if bounded(differing, 500_000) else differing, ["g", "ord", "k", "k2"])
    named = found.dropDuplicates(["g", "ord", "k", "k2", "change"]).withColumn("ord", F.col("ord") + F.when(F.col("change") == "removed", 1).otherwise(0))
    labels = index.select(*names, "at", "ord", g.alias("g"))
    out = named.join(F.broadcast(labels) if bounded(labels, 200_000) else labels, ["g", "ord"])
    return out.select(*[F.col(n).alias(c) for c, n in zip(group, names)], F.col("at").alias(at), "key", "change")
