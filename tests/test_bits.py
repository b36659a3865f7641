"""Levels by bit sets against the same levels by joins and by a plain search."""

import random

from skein.operators import bits, overloads


def plain_levels(links, depth):
    """(child, parent): least number of links up, by a search from every child."""
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    out = {}
    for start in up:
        seen, front = {start}, {start}
        for level in range(1, depth + 1):
            front = {p for c in front for p in up.get(c, ())} - seen
            seen |= front
            out |= {(start, p): level for p in front}
    return out


def test_closure_by_bits_equals_joins_and_search(spark, monkeypatch):
    """More sources than a group of bits holds, cycles, and paths that end at the depth. Pairs are made once, not joined."""
    rng = random.Random(7)
    links = sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(1500), rng.randrange(1500)) for _ in range(1900)) if a != b})
    df = spark.createDataFrame(links, "child string, parent string")
    want = plain_levels(links, 6)
    assert max(want.values()) == 6 and len(want) > 10_000
    by_bits = overloads.type_closure(spark, df, 6)
    assert "MapInArrow" in by_bits._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(bits, "MOST", 0)
    by_joins = overloads.type_closure(spark, df, 6)
    assert "MapInArrow" not in by_joins._jdf.queryExecution().optimizedPlan().toString()
    for closure in (by_bits, by_joins):
        rows = [(r.child, r.parent, r.depth) for r in closure.where("depth > 0").toLocalIterator()]
        assert len(rows) == len(want) and {(a, b): d for a, b, d in rows} == want
    assert overloads.type_closure(spark, df.limit(0)).count() == 0


def test_names_closure_is_not_gathered_again(spark, data):
    """x30 gives its pairs as they are found: each comes once, so nothing is grouped over them."""
    from skein.queries import all_queries

    df = all_queries()["x30_type_depth"](spark, data)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < (plan.index("Aggregate") if "Aggregate" in plan else len(plan))
    assert df.count() == df.select("child", "parent").distinct().count()


def test_route_chains_by_bits_equal_joins(spark, monkeypatch):
    """Random calls with declared types, dispatches into new and known nodes, unknown functions and shared handlers."""
    from skein.operators import traverse

    rng = random.Random(5)
    node = lambda: f"f{rng.randrange(60)}"
    fn = spark.createDataFrame([(f"f{i}", None if i == 59 else f"p.T{i % 5}.f{i}") for i in range(60)], "id string, qualified_name string")
    edge = "src string, dst string, confidence double, line int, declared_type string, chain_id int, chain_depth int"
    calls = [(node(), node(), rng.choice([None, 0.2, 0.9]), k, rng.choice([None, "", *(f"p.T{i}" for i in range(5)), "p"]), 0, 0) for k in range(110)]
    calls = spark.createDataFrame([*calls, ("f1", "gone", 0.9, 1, "p.T1", 0, 0)], edge)
    sent = spark.createDataFrame([(node(), node(), rng.choice([None, 0.2, 0.9])) for _ in range(70)] + [("gone", "f2", 0.9), ("f2", "lost", 0.9)], "src string, dst string, confidence double")
    owned = spark.createDataFrame([(f"r{k}", f"f{k % 50}") for k in range(90)] + [("r90", "none")], "owner string, id string")
    rows = lambda: sorted((r.owner, r.id, r.level) for r in traverse.owned_chain(fn, calls, sent, owned, 4, 0.5).collect())
    monkeypatch.setattr(traverse, "call_chain", None)  # the joins are not taken
    by_bits = rows()
    monkeypatch.undo()
    monkeypatch.setattr(bits, "MOST", 0)
    assert by_bits == rows()
    assert len(by_bits) > 300 and {level for *_, level in by_bits} == {1, 2, 3, 4}
