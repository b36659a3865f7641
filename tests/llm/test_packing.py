"""Packing: every document once, capacities kept, copies apart, fill close to the least possible."""

import os
import random

import pytest

from skein.llm.packing import VOCABULARY, Bins, pack, pack_documents

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


def test_best_fit_against_plain_search():
    rnd = random.Random(4)
    for _ in range(20):
        capacity = rnd.randint(5, 40)
        sizes = [rnd.randint(0, capacity) for _ in range(80)]
        clusters = [rnd.choice([None, None, 1, 2, 3]) for _ in sizes]
        got = pack(sizes, clusters, [None] * len(sizes), capacity)
        bins = []  # residual, clusters
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fit = [b for b in bins if b[0] >= sizes[i] and (clusters[i] is None or clusters[i] not in b[1])]
            if fit:
                b = min(fit, key=lambda b: b[0])
            else:
                bins.append(b := [capacity, set()])
            b[0] -= sizes[i]
            b[1].add(clusters[i])
        load = {}
        for i, b in enumerate(got):
            load.setdefault(b, []).append(i)
        for members in load.values():
            assert sum(sizes[i] for i in members) <= capacity
            named = [clusters[i] for i in members if clusters[i] is not None]
            assert len(named) == len(set(named))
        assert abs(len(load) - len(bins)) <= 1


def test_bins_prefer_a_source_they_lack():
    b = Bins(10)
    assert [b.place(6, 0, 1), b.place(6, 0, 2), b.place(4, 0, 2)] == [0, 1, 0]


@pytest.mark.parametrize("shard", [20_000, 40])
def test_documents(spark, shard):
    rnd = random.Random(6)
    docs = [(i, rnd.choice([None, "a", "a", "b"]), " ".join(rnd.choice(["one", "two", "three"]) + str(rnd.randint(0, 99)) for _ in range(rnd.choice([0, 3, 20, 60])))) for i in range(300)]
    docs += [(1000 + i, "a", "The same text, again!") for i in range(10)] + [(2000, None, None), (2001, "b", ""), (2002, "b", "long text " * 3000), (5, None, docs[5][2]), (None, "a", "x")]
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, source string, text string, n_tokens int, shard string")
    sizes = spark.createDataFrame([("s", 64, 1), ("m", 256, 1), ("s", 64, 1), ("bad", 0, 1), (None, 5, 1), ("nul", None, 1)], "pack_name string, capacity_tokens int, capacity int")
    rows = pack_documents(d, sizes, shard_documents=shard).collect()
    for name, capacity in (("s", 64), ("m", 256)):
        mine = [r for r in rows if r.pack_name == name]
        pieces = {}
        load = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
            load.setdefault(r.container, []).append(r)
        assert set(pieces) == {x[0] for x in docs if x[0] is not None}
        for got in pieces.values():
            got.sort()
            assert [p for p, _ in got] == list(range(len(got))) and all(n == capacity for _, n in got[:-1])
        assert all(sum(r.n_tokens for r in x) <= capacity for x in load.values())
        assert all(sum(r.doc_id is not None and 1000 <= r.doc_id < 1010 for r in x) <= 1 for x in load.values())
    assert {r.pack_name for r in rows} == {"s", "m"}
    assert pack_documents(d.limit(0), sizes).count() == 0


def test_more_than_a_thousand_sizes(spark):
    d = spark.createDataFrame([(1, "a", "some words here"), (2, None, "other words there")], "doc_id long, source string, text string")
    sizes = spark.createDataFrame([(f"s{i}", 10 + i) for i in range(1001)], "pack_name string, capacity_tokens int")
    assert pack_documents(d, sizes).select("pack_name").distinct().count() == 1001
