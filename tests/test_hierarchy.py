"""Hierarchies against brute force: random forests, a deep chain, a wide parent, cycles."""

import random

import pytest

from skein.operators import hierarchy as H
from skein.operators.hierarchy import build_hierarchy, descendants_of, full_paths
from skein.queries import hierarchy as Q


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = {*parent, *parent.values()}
    out = {}
    for n in nodes:
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at not in parent:
            out[n] = (at, len(seen), "/".join([at, *reversed(seen)]))
        else:
            out[n] = ("", -1 if at == n else -2, None)
    return out


def check(spark, links):
    h = build_hierarchy(spark.createDataFrame([(c, p, "z", 1) for c, p in links], "child string, parent string, node string, size int"))
    paths = {r.node: r.path for r in full_paths(h).collect()}
    got = {r.node: (r.root_id, r.depth, paths.get(r.node)) for r in h.nodes.collect()}
    want = brute(links)
    assert got == want
    below = {}
    for n, (root, depth, path) in want.items():
        if depth >= 0:
            for a in path.split("/")[:-1]:
                below.setdefault(a, set()).add(n)
    sizes = {r.node: r.size for r in h.nodes.where("head is not null").collect()}
    assert sizes == {n: 1 + len(below.get(n, ())) for n, v in want.items() if v[1] >= 0}
    some = sorted(below)[:5]
    found = {}
    for r in descendants_of(h, spark.createDataFrame([(s,) for s in some] or [("none",)], "node string")).collect():
        found.setdefault(r.node, set()).add(r.descendant)
    assert found == {s: below[s] for s in some}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph_with_cycles(spark, seed):
    rnd = random.Random(seed)
    links = [(f"n{i}", f"n{rnd.randrange(60)}" if rnd.random() < 0.3 else f"n{rnd.randrange(i)}") for i in range(1, 60)]
    check(spark, links + links[:5])


def test_deep_chain_wide_parent_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_LEAST", 5)
    links = [(f"d{i:02}", f"d{i + 1:02}") for i in range(20)] + [(f"w{i:02}", "d05") for i in range(25)]
    links += [("self", "self"), ("under", "self"), (None, "d01"), ("d02", None), ("x", "y"), ("y", "x"), ("tail2", "tail1"), ("tail1", "x")]
    check(spark, links)


def test_empty(spark):
    h = build_hierarchy(spark.createDataFrame([], "child string, parent string"))
    assert h.nodes.count() == 0 and full_paths(h).count() == 0


def test_queries_give_every_class_and_all_descendants(spark, monkeypatch):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self")]
    monkeypatch.setattr(Q, "class_links", lambda spark, sf: spark.createDataFrame(links, "child string, parent string"))
    want = brute(links)
    rows = {r.class_id: r for r in Q.queries()["p2_classes"](spark, "").collect()}
    assert {k: (r.root_id, r.depth, r.path) for k, r in rows.items()} == want
    below = {(a, n) for n, v in want.items() if v[2] for a in v[2].split("/")[:-1]}
    assert sorted(map(tuple, Q.queries()["p2_descendants"](spark, "").collect())) == sorted(below)
    trees = [r for r in rows.values() if r.depth >= 0]
    assert {(a.class_id, n.class_id) for a in trees for n in trees if a.root_id == n.root_id and a.first < n.first <= a.first + a.n_descendants} == below
