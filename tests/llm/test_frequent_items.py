"""Majority-vote sketch: bounds hold for any order of adding and merging; results equal exact counts."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from skein.llm.frequent_items import VoteSketch, bounds, most_frequent


def holds(sketch, counts):
    found, lower, upper, others = bounds(sketch)
    for h, a, b in zip(found.tolist(), lower.tolist(), upper.tolist()):
        assert a <= counts.get(h, 0) <= b
    assert all(n <= others for h, n in counts.items() if h not in set(found.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 20), min_size=0, max_size=40), min_size=1, max_size=5))
def test_bounds_hold(parts):
    total = VoteSketch.empty(2, 4)
    for p in parts:
        one = VoteSketch.empty(2, 4)
        for chunk in (p[:7], p[7:]):
            if chunk:
                one.add(*np.unique(np.array(chunk, np.int64), return_counts=True))
        row, cell = np.nonzero(one.total)
        total.merge(row, cell, one.total[row, cell], one.candidate[row, cell], one.surplus[row, cell])
    holds(total, Counter(x for p in parts for x in p))


def top(spark, values, k=5, **kw):
    df = spark.createDataFrame([(v, 1, "c") for v in values], "v string, n long, h string").repartition(3)
    return [(r.item_value, r.n) for r in most_frequent(df, "v", k, **kw).orderBy("n", ascending=False).collect()]


def test_equals_exact_counts_even_from_a_small_sketch(spark):
    rnd = random.Random(1)
    values = [rnd.choice(["hot"] * 5 + [f"v{int(rnd.paretovariate(1))}" for _ in range(5)]) for _ in range(4000)] + [None, ""] * 50
    want = sorted(Counter(v for v in values if v).items(), key=lambda x: (-x[1], x[0]))[:5]
    for width in (4, 1024):
        got = top(spark, values, width=width)
        assert sorted(got, key=lambda x: (-x[1], x[0])) == want


def test_edge_cases(spark):
    assert top(spark, []) == [] and top(spark, [None, ""]) == []
    assert top(spark, ["b", "a", "c"], k=2) == [("a", 1), ("b", 1)]
    long = "x" * 100_000
    assert top(spark, [long, long, "y"], k=1) == [(long, 2)]


def test_flat_columns_are_counted_when_no_sketch_tells(spark):
    df = spark.range(400).select((F.col("id") % 100).cast("string").alias("v"))
    got = [(r.item_value, r.n) for r in most_frequent(df, "v", 3, width=4, max_width=4).collect()]
    assert got == [("0", 4), ("1", 4), ("10", 4)]
