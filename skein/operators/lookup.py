"""Lookup joins that stay even when a few keys hold most rows of the left side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 200  # a key is hot from 1/200 of the rows on, so at most 200 keys are
HOT_LEAST = 50_000


def hot_keys(df: DataFrame, on: list[str], share: int = HOT_SHARE, least: int = HOT_LEAST) -> list[tuple]:
    """Keys with more than 1/share of df's rows and more than `least` rows: fewer than `share` keys, by construction."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.where(F.col("_n") > least)
    found = large.orderBy(F.desc("_n")).limit(share).collect()
    if not found:
        return []
    total = df.count()
    return [tuple(r[c] for c in on) for r in found if r["_n"] > total / share]


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot: list[tuple] | None = None) -> DataFrame:
    """left joined to right, whose rows are unique per key `on`.

    Rows of hot keys look their one right row up in a broadcast table of fewer than HOT_SHARE rows; all other rows take
    a shuffled join. Null keys match nothing. `how` is left or inner.
    """
    hot = hot_keys(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    is_hot = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(on, k)]) for k in hot])
    first = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
    return first.unionByName(left.where(~is_hot).join(right, on, how))
