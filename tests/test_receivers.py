"""Resolution over receivers: one call per strategy, and overrides in all ancestors."""

from pyspark.sql import functions as F

from skein.operators import receivers as R

PARAMS = "array<struct<name:string,type:string,has_default:boolean>>"


def tables(spark):
    functions = [
        ("f1", "save", "p.a.Base.save", "p/a.py", [("x", "int", False)]), ("f2", "run", "p.a.Child.run", "p/a.py", [("repo", "Repo", False)]), ("f3", "find", "p.b.Repo.find", "p/b.py", []), ("f4", "find", "p.b.Repo.find", "p/b.py", [("k", "int", False)]),
        ("f5", "helper", "p.a.Tools.helper", "p/a.py", []), ("f6", "find", "q.c.Other.find", "q/c.py", []), ("f7", "go", "q.c.Other.go", "q/c.py", []), ("f8", "cb", "p.a.Child.cb", "p/a.py", []),
    ]
    f = spark.createDataFrame(functions, f"id string, name string, qualified_name string, file_path string, parsed {PARAMS}")
    c = spark.createDataFrame([("k1", "Base", "p.a.Base", "p/a.py", "p", '[{"name":"store","type":"Repo<int>"}]'), ("k2", "Child", "p.a.Child", "p/a.py", "p", None), ("k3", "Repo", "p.b.Repo", "p/b.py", "p", "[]"), ("k4", "Repo", "q.c.Repo", "q/c.py", "q", None), ("k5", "Tools", "p.a.Tools", "p/a.py", "p", None)], "id string, name string, qualified_name string, file_path string, source_project string, fields string")
    up = spark.createDataFrame([("k2", "k1", 1)], "class_id string, ancestor string, level int")
    ext = spark.createDataFrame([("e1", "print", "fmt.print"), ("e2", "lone", "lib.lone")], "id string, name string, qualified_name string")
    calls = [
        (1, "save", "p.a.Child.run", "p/a.py", 1, "super"), (2, "save", "p.a.Child.run", "p/a.py", 1, "self"), (3, "find", "p.a.Child.run", "p/a.py", 1, "repo"), (4, "find", "p.a.Child.run", "p/a.py", 0, "self.store"), (5, "find", "p.a.Child.run", "p/a.py", 7, "Repo"),
        (6, "helper", "p.a.Child.run", "p/a.py", 0, ""), (7, "print", "p.a.Child.run", "p/a.py", 0, "fmt"), (8, "lone", "p.a.Child.run", "p/a.py", 0, ""), (9, "nowhere", "p.a.Child.run", "p/a.py", 0, "os.path"), (10, "nowhere", "p.a.Child.run", "p/a.py", 0, "f(x)"), (11, None, None, None, None, ""),
    ]
    return spark.createDataFrame(calls, "call_id int, called_name string, caller_name string, file_path string, arg_count int, receiver string"), f, c, up, ext


def test_every_strategy(spark):
    calls, f, c, up, ext = tables(spark)
    got = {}
    for r in R.resolve_ranked(calls, f, c, up, ext).collect():
        got.setdefault(r.call_id, set()).add((r.target_id, r.resolved_by, round(r.confidence, 3)))
    assert got == {
        1: {("f1", "super_call", 0.95)}, 2: {("f1", "hierarchy", 0.95)}, 3: {("f4", "arg_count", 0.85)}, 4: {("f3", "arg_count", 0.85)}, 5: {("f3", "type_multi", 0.325), ("f4", "type_multi", 0.325)},
        6: {("f5", "same_package", 0.85)}, 7: {("e1", "external", 0.7)}, 8: {("e2", "external", 0.7)}, 9: {("external:os.path.nowhere", "external", 0.7)},
    }
    types = {r.call_id: (r.class_id, r.source) for r in R.receiver_types(calls, f, c, up).collect()}
    assert types == {2: ("k2", "self"), 3: ("k3", "parameter"), 4: ("k3", "inherited_field"), 5: ("k3", "class_name")}
    assert R.resolve_ranked(calls.limit(0), f, c, up, ext).count() == 0


def test_callbacks(spark):
    _, f, *_ = tables(spark)
    calls = spark.createDataFrame([(1, "p/a.py", ["self.cb", "cb", "x + 1", "Child::cb"]), (2, "q/c.py", ["cb"]), (3, None, None)], "call_id int, file_path string, arg_exprs array<string>")
    assert {(r.call_id, r.id) for r in R.callback_references(calls, f).collect()} == {(1, "f8")}
