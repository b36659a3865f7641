"""Snapshot differences, balanced key statistics, orphan references: small cases and edge cases."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from skein.operators.balanced import balanced_key_counts, balanced_key_stats
from skein.operators.lookup import hot_keys, lookup_join
from skein.operators.orphans import merge_deltas, orphan_keys, orphan_rows, orphans_of, reference_deltas
from skein.operators.prefix_sum import number_rows
from skein.operators.snapshots import snapshot_changes
from skein.queries.processing import canonical_path
from skein.storage import Scratch

T = datetime(2025, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def stats(df, chunk):
    return {r.key_value: (r.n_rows, r.n_members, r.first_at, r.last_at) for r in balanced_key_stats(df, "k", "m", "t", chunk).collect()}


def test_balanced_matches_plain_counts_with_a_hot_key(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice(["x", "y", "z", None, "w"]), datetime(2025, 1, rnd.randint(1, 28))) for _ in range(600)]
    df = spark.createDataFrame(data, "k string, m string, t timestamp").repartition(5)
    want = {}
    for k in {d[0] for d in data}:
        of = [d for d in data if d[0] == k]
        want[k] = (len(of), len({d[1] for d in of} - {None}), min(d[2] for d in of), max(d[2] for d in of))
    for chunk in (1, 3, 1000):
        assert stats(df, chunk) == want


def test_key_counts_cut_hot_keys_at_chunk_ends(spark):
    data = [("hot",)] * 70 + [("a",)] * 5 + [(None,)] * 3 + [(f"r{i}",) for i in range(20)]
    df = spark.createDataFrame(data, "n string").select(F.col("n").alias("p"), F.lit(1).alias("n")).repartition(6)
    for chunk in (1, 7, 50, 1000):
        got = {r.key_value: (r.n_rows, r.n_chunks) for r in balanced_key_counts(df, "p", chunk).collect()}
        assert {k: v[0] for k, v in got.items()} == {"hot": 70, "a": 5, None: 3, **{f"r{i}": 1 for i in range(20)}}
        assert 70 / chunk <= got["hot"][1] <= 70 / chunk + 2
    assert balanced_key_counts(df.limit(0), "p").count() == 0


def test_balanced_nulls_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, None, 1, 2), ("a", None, T, 1, 2), (None, "m", None, 1, 2)], "k string, m string, t timestamp, chunk int, n int")
    assert stats(df, 1) == {"a": (2, 0, T, T), None: (1, 1, None, None)}
    assert stats(df.limit(0), 1) == {}


def test_number_rows_is_a_total_order(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("a"), "id")
    got = sorted((r.pos, r.a, r.id) for r in number_rows(df, ["a", "id"], "pos", Scratch(spark), 3).collect())
    assert [g[0] for g in got] == list(range(100))
    assert [g[1:] for g in got] == sorted((i % 7, i) for i in range(100))


def test_lookup_join_splits_hot_keys(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("c", "C"), ("x", "X")], "k string, w string")
    hot = hot_keys(left, ["k"], share=2, least=10)
    assert hot == [("h",)]
    plain = rows(left.join(right, "k", "left").select("k", "v", "w"))
    assert rows(lookup_join(left, right, ["k"], "left", hot).select("k", "v", "w")) == plain
    assert rows(lookup_join(left, right, ["k"], "inner", hot).select("k", "v", "w")) == rows(left.join(right, "k").select("k", "v", "w"))


def test_orphan_reasons(spark):
    records = spark.createDataFrame(
        [("s", "live", 1, None), ("s", "dead", 1, 3), ("s", "late", 9, None), ("s", "back", 1, 2), ("s", "back", 4, None), ("s", "never", None, None), ("s", "odd", 5, 4)],
        "space string, key string, since int, until int",
    )
    refs = spark.createDataFrame(
        [("s", k, m, i, "x") for i, (k, m) in enumerate([("live", 1), ("live", 0), ("dead", 2), ("dead", 3), ("late", 8), ("late", 9), ("back", 3), ("back", 4), ("none", 1), ("never", 1), ("odd", 6), (None, 1), ("live", None), ("none", 1)])],
        "space string, key string, month int, id int, reason string",
    )
    orphans = orphan_keys(refs.withColumn("n", F.lit(1)), records, ["space"])
    got = {(r.key, r.month): r.reason for r in orphan_rows(refs, orphans, ["space"]).collect()}
    assert got == {("live", 0): "late", ("dead", 3): "deleted", ("late", 8): "late", ("back", 3): "deleted", ("none", 1): "missing", ("never", 1): "deleted", ("odd", 6): "deleted"}
    assert {r.key: r.refs for r in orphans.collect()}["none"] == 2
    assert rows(orphan_keys(refs.limit(0).withColumn("n", F.lit(1)), records, ["space"])) == []


SNAP = "p string, b string, at long, files map<string,struct<mod_time:long,size:long,content_hash:string>>, delivered timestamp, g long, k string"


def diff(spark, data, **kw):
    df = spark.createDataFrame([(*d, 1, "clash") for d in data], SNAP)
    return rows(snapshot_changes(df, ["p", "b"], "at", "delivered", "files", key=canonical_path, content=lambda v: v["content_hash"], weak=["mod_time", "size"], **kw))


def test_snapshot_changes(spark):
    a = {"./x": (1, 1, "AA"), "y\\z": (1, 1, None), "same": (1, 1, "q"), "gone": (1, 1, "g"), "w": (1, 1, "")}
    b = {"x": (9, 9, "aa"), "y/z": (2, 1, None), "same": (1, 1, "r"), "new": (1, 1, "n"), "w": (1, 1, "zz")}
    data = [("p", "m", 2, b, T), ("p", "m", 1, a, T), ("p", "m", 2, b, T), ("q", None, 5, a, None), ("p", "m", None, a, T), ("p", "m", 3, None, T), ("p", "m", 4, {}, T)]
    want = [("p", "m", 2, "gone", "removed"), ("p", "m", 2, "new", "added"), ("p", "m", 2, "same", "changed"), ("p", "m", 2, "y/z", "changed")]
    want += [("p", "m", 4, k, "removed") for k in ("x", "y/z", "same", "new", "w")]
    assert diff(spark, data) == sorted(want, key=repr)
    assert diff(spark, data, bucket_rows=2) == sorted(want, key=repr)
    assert diff(spark, []) == []


def test_snapshot_random_against_brute_force(spark):
    rnd = random.Random(5)
    data, want = [], []
    for p in ("a", "b"):
        before = None
        for at in range(5):
            now = {f"f{i}": (rnd.randint(0, 1), 1, rnd.choice([None, "h", "H", "k"])) for i in range(30) if rnd.random() < 0.7}
            data.append((p, "m", at, now, T))
            if before is not None:
                for k in {*before, *now}:
                    if k not in now or k not in before:
                        want.append((p, "m", at, k, "removed" if k not in now else "added"))
                    else:
                        x, y = before[k], now[k]
                        if (x[2].lower() != y[2].lower()) if x[2] and y[2] else x[:2] != y[:2]:
                            want.append((p, "m", at, k, "changed"))
            before = now
    rnd.shuffle(data)
    assert diff(spark, data, bucket_rows=7) == sorted(want, key=repr)


def test_maintained_orphans_equal_those_of_all_rows(spark):
    rnd = random.Random(8)
    refs = [("a", rnd.choice("xyzw"), rnd.randint(1, 6), 1) for _ in range(40)]
    records = [("a", rnd.choice("xyz"), s := rnd.choice([None, 1, 3, 5]), rnd.choice([None, None if s is None else s + 2])) for _ in range(6)]
    r = lambda rows: spark.createDataFrame(rows, "scope string, key string, month int, n int")
    k = lambda rows: spark.createDataFrame(rows, "scope string, key string, since int, until int")
    state = reference_deltas(r(refs[:15]), k(records[:2]), ["scope"])
    for a, z, b, y in ((15, 30, 2, 5), (30, 40, 5, 6)):
        state = merge_deltas(state, reference_deltas(r(refs[a:z]), k(records[b:y]), ["scope"]), ["scope"])
    assert rows(orphans_of(state, ["scope"])) == rows(orphan_keys(r(refs), k(records), ["scope"]))
    back = reference_deltas(r([(s, key, m, -n) for s, key, m, n in refs]), k([]), ["scope"])
    assert orphans_of(merge_deltas(state, back, ["scope"]), ["scope"]).count() == 0
