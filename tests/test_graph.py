"""Traversal, modes, resolution and lookups over small literal graphs."""

from skein.functions import scalars as S
from skein.operators import lookups as L
from skein.operators import modes
from skein.operators.resolve import export_closure, fixpoint_types, linearise, resolve_calls
from skein.operators.traverse import call_chain, reachable_sizes, truncated
from skein.storage import Scratch

EDGE = "edge_id long, src string, dst string, confidence double, line int, declared_type string, chain_id int, chain_depth int"


def graph(spark, extra=()):
    fn = spark.createDataFrame(
        [("a", "a", "com.x.A.a", "f", False, False, False), ("b", "run", "com.x.Base.run", "f", False, False, False), ("c1", "run", "com.x.Impl1.run", "f", False, False, False), ("c2", "run", "com.x.Impl2.run", "f", False, False, False), ("d", "d", "com.x.D.d", "f", False, False, False), ("log", "info", "log.info", "[external]", False, False, False)],
        "id string, name string, qualified_name string, file_path string, is_getter boolean, is_setter boolean, is_constructor boolean",
    )
    data = [(1, "a", "b", 0.95, 3, "com.x.Impl1", 0, 0), (2, "a", "b", 0.85, 9, "com.x.Impl1", 0, 0), (3, "c1", "d", 0.25, 5, None, 7, 1), (4, "c1", "log", 0.95, 6, None, 7, 0), *extra]
    calls = spark.createDataFrame(data, EDGE)
    sent = spark.createDataFrame([(9, "b", "c1", 1.0), (10, "b", "c2", 1.0)], "edge_id long, src string, dst string, confidence double")
    return fn, calls, sent


def chain(spark, depth=2, least=0.0, reverse=False, root="a", extra=()):
    fn, calls, sent = graph(spark, extra)
    return call_chain(fn, calls, sent, spark.createDataFrame([(root,)], "id string"), depth, reverse, least)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_forward_chain_narrows_dispatch_to_declared_types(spark):
    sub = chain(spark)
    assert {r.id: r.level for r in sub.nodes.collect()} == {"b": 1, "c1": 1, "d": 2, "log": 2}
    assert ids(chain(spark, least=0.7).nodes) == ["b", "c1", "log"]


def test_reverse_chain_keeps_edge_direction(spark):
    sub = chain(spark, root="d", reverse=True)
    assert ids(sub.nodes) == ["a", "b", "c1"]
    assert ("c1", "d", "CALLS") in {(r.src, r.dst, r.kind) for r in sub.edges.collect()}


def test_deeper_chains_hold_shallower_ones(spark):
    one, two = set(ids(chain(spark, 1).nodes)), set(ids(chain(spark, 2).nodes))
    assert one <= two
    fn, calls, sent = graph(spark)
    assert [r.text for r in truncated(chain(spark, 1), fn, calls, sent).collect() if r.id == "c1"] == ["com.x.Impl1.run (2 direct callees not expanded)"]


def test_modes(spark):
    fn, *_ = graph(spark)
    sub = chain(spark)
    nodes = sub.nodes.join(fn, "id")
    kept, edges = modes.core(nodes, sub.edges)
    assert ids(kept) == ["b", "c1", "d"]
    assert [(tuple(r.lines), r.confidence) for r in modes.compact(sub.edges).where("dst = 'b'").collect()] == [((3, 9), 0.95)]
    assert ids(modes.dry(nodes, sub.edges, Scratch(spark))[0]) == []  # the override hung on the base method alone
    sub = chain(spark, extra=[(5, "a", "c1", 0.9, 4, None, 0, 0)])
    assert ids(modes.dry(sub.nodes.join(fn, "id"), sub.edges, Scratch(spark))[0]) == ["c1", "d"]
    assert [(r.chain_id, r.steps) for r in modes.chains(sub.edges).collect()] == [(7, "log>d")]
    assert modes.declared_type_only(chain(spark, root="b", reverse=True).edges, "com.x.Impl1").count() == 2


def test_levels_peel_cycles_last(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.id: r.level for r in reachable_sizes(e, Scratch(spark)).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_resolution_order(spark):
    fn = spark.createDataFrame([("1", "f", "m.f", "a", 1), ("2", "f", "n.f", "b", 2), ("3", "g", "m.g", "b", 0), ("4", "h", "m.h", "x", 1), ("5", "h", "n.h", "y", 1)], "id string, name string, qualified_name string, file_path string, n_params int")
    ext = spark.createDataFrame([("e", "p", "lib.p")], "id string, name string, qualified_name string")
    calls = spark.createDataFrame(
        [(1, "m.f", "z", 9, None, True), (2, "f", "a", 9, None, None), (3, "f", "z", 2, None, None), (4, "g", "z", 5, None, None), (5, "p", "z", 0, "", None), (6, "h", "z", 1, "it", False), (7, None, "z", 1, None, None), (2, "f", "a", 9, None, None)],
        "call_id long, called_name string, file_path string, arg_count int, receiver_expr string, is_pre_resolved boolean",
    )
    edges, hints = resolve_calls(calls, fn, ext)
    assert {r.call_id: (r.target_id, r.resolved_by) for r in edges.collect()} == {1: ("1", "pre_resolved"), 2: ("1", "same_file"), 3: ("2", "arg_count"), 4: ("3", "name_unique"), 5: ("e", "external")}
    assert [(r.call_id, r.hint_type, r.candidates, r.shown) for r in hints.collect()] == [(6, "lambda_call", 2, "4,5")]  # a receiver without type, dot or call


def test_fixpoints_and_linearisation(spark):
    s = Scratch(spark)
    types = fixpoint_types(spark.createDataFrame([("s", "a", "T")], "scope string, var string, type string"), spark.createDataFrame([("s", "b", "a"), ("s", "c", "b"), ("s", "a", "c")], "scope string, lhs string, rhs string"), s)
    assert {r.var: r.type for r in types.collect()} == {"a": "T", "b": "T", "c": "T"}
    out = export_closure(spark.createDataFrame([("a", "f")], "file string, symbol string"), spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "file string, source string"), s)
    assert sorted(r.file for r in out.collect()) == ["a", "b", "c"]
    mro = linearise(spark.createDataFrame([("r", "D", ["B", "C"]), ("r", "B", ["A"]), ("r", "C", ["A"]), ("r", "A", [])], "root string, child string, parents array<string>"))
    assert {r.class_name: r.mro for r in mro.collect()}["D"] == ["D", "B", "C", "A"]


def test_smallest_span_and_resolve(spark):
    fn = spark.createDataFrame([("o", "outer", "m.outer", "f", 1, 200), ("i", "inner", "m.outer.inner", "f", 70, 80)], "id string, name string, qualified_name string, file_path string, start_line int, end_line int")
    asked = spark.createDataFrame([("f", 75), ("f", 5), ("f", 500), ("g", 1)], "file_path string, line int")
    assert {r.line: r.id for r in L.smallest_span(asked, fn).collect()} == {75: "i", 5: "o"}
    got = L.resolve(fn, spark.createDataFrame([("outer.inner",), ("m.outer",), ("inner",), ("no",)], "text string"))
    assert {r.text: (r.id, r.rank) for r in got.collect()} == {"outer.inner": ("i", 1), "m.outer": ("o", 0), "inner": ("i", 1)}


def value(spark, column, *args):
    from pyspark.sql import functions as F

    return spark.range(1).select(column(*[F.lit(a) for a in args]).alias("v")).collect()[0].v


def test_scalar_truth_table(spark):
    v = lambda f, *a: value(spark, f, *a)
    assert (v(S.url_path, "https://svc:8080/v1/item/42?x=1"), v(S.url_service, "https://svc:8080/v1/item/42?x=1")) == ("/v1/item/{param}", "svc")
    assert (v(S.url_path, "/v1/:key"), v(S.url_service, "http://127.0.0.1/p"), v(S.url_path, "")) == ("/v1/{param}", "", "")
    assert [v(S.query_type, x) for x in (" select 1", "from t", "delete from t", "merge into t")] == ["SELECT", "SELECT", "DELETE", "UNKNOWN"]
    assert v(S.sql_tables, "SELECT * FROM a JOIN b ON 1=1 JOIN c ON 1=1") == ["a", "b"]
    assert v(S.sql_tables, "UPDATE a SET x=1") == ["a"]
    assert [v(S.is_sql_statement, x) for x in ("SELECT x", "SELECTx", "CREATE TABLE t")] == [True, False, False]
    assert [v(S.proto_service, x) for x in ("NewPayServiceClient", "PayServiceStub", "NewClient")] == ["PayService", "PayService", ""]
    assert [v(S.strip_nullable, x) for x in ("Optional[A]", "A | null", "A | B", "None")] == ["A", "A", "A | B", ""]
    assert [v(S.annotation_base, x) for x in ("@p.q.Name(x=1)", "@a.b")] == ["Name", "a.b"]
    assert [v(S.segments_match, *x) for x in (("/a/{param}", "/a/{k}"), ("/a", "/a/{k}"), ("/a/b", "/a/c"))] == [True, False, False]
    assert v(S.memory_limit, "4GB") == 4 << 30 and v(S.derive_package, "a/b/__init__.py") == "a.b" and v(S.constructor_type, "NewFoo") == "Foo"
    assert v(S.params_summary, '[{"name":"a","type":"int"},{"name":"b","type":"str"}]') == "(int, str)"
