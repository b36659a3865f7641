"""Truth tables of scalar rules, route matching and the choice among overloads."""

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators import overloads
from skein.operators.routes import match_routes


def values(spark, function, texts, show=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select((show or (lambda c: c))(function(F.col("s")))).collect()]


def check(spark, function, table, show=None):
    assert values(spark, function, list(table), show) == list(table.values())


def test_urls_and_paths(spark):
    paths = {
        "http://user-service/api/users/123?page=1": "/api/users/{param}", "http://user-service:8080/api/users/{id}": "/api/users/{param}", "/api/users/<int:id>": "/api/users/{param}",
        "http://svc/api/${userId}": "/api/{param}", "/a?x=1+2": "/a", "base + '/x'": "", "": "", "`/a/b`": "/a/b", "/a`b": "/a`b",
    }
    check(spark, S.url_path, paths)
    check(spark, S.url_service, {"http://user-service:8080/a": "user-service", "http://localhost:8081/a": "", "/a": ""})
    check(spark, S.derive_package, {"pkg-a/index.ts": "pkg-a", "src/utils/index.tsx": "src.utils", "index.ts": "index", "models/__init__.py": "models", "__init__.py": "__init__", "a/B.java": "a.B.java"})
    check(spark, S.is_catch_all, {"**": True, "*": True, "[...x]": True, "[[...x]]": True, "{id}": False})


def test_names(spark):
    check(spark, S.proto_service, {"NewUserServiceClient": "UserService", "RegisterUserServiceServer": "UserService", "add_UserServiceServicer_to_server": "UserService", "UserBlockingStub": "UserBlocking", "XGrpc": "X", "Stub": "", "NewClient": ""})
    check(spark, S.enum_constant, {"Color.RED": True, "Color.RED_1": True, "Color.R-1": True, "color.RED": False, "Color.Red": False, "Color.": False, ".RED": False, "Color": False})
    check(spark, S.owner_outside_parens, {"D.parse(r.get()).time()": "D.parse(r.get())", "a.b": "a", "f(a.b)": "", "": "", "a": ""})
    check(spark, lambda c: S.grpc_invoke(c)["method"], {"/UserService/GetUser": "GetUser", "UserService": "", "/a/b/c": "b/c"})
    check(spark, S.multi_values, {'{"/a", "/b"}': ["/a", "/b"], "/a": ["/a"], "": [""], ' "x" ': ["x"]})
    check(spark, S.request_methods, {"{RequestMethod.GET, RequestMethod.POST}": ["GET", "POST"], "RequestMethod.HEAD": []})
    check(spark, S.annotation_value, {'@GetMapping("/a")': "/a", '@X(value = "/b", produces = "j")': "/b", '@X(path={"/c"})': "/c", "@X": "", "@X()": "", "@X(NAME)": "NAME"})
    check(spark, S.memory_limit, {"4GB": 4 << 30, "1.5 mb": 3 << 19, "7": 7, "12B": 12, "": (1 << 63) - 1, "0": (1 << 63) - 1, "x": None})


def test_files(spark):
    check(spark, S.is_test_file, {"a/b_test.go": True, "a/FooTest.java": True, "a/FooSpec.java": True, "a/FooIT.java": False, "test_x.py": True, "x_test.py": True, "a.spec.tsx": True, "a.test.js": True, "latest.ts": False, "Test.txt": False})
    check(spark, S.in_test_directory, {"a/specs/b.ts": True, "__mocks__/b.js": True, "a/testdata/b.go": False, "x/src/test/b.java": True, "src/test/b.py": True, "x/asrc/test2/b.java": False, "tests.py": False})
    check(spark, S.in_ignored_directory, {"a/.next/b.ts": True, "venv/b.py": True, "a/vendors/b.go": False})
    check(spark, S.is_sql_stub, {"reset x": True, "with t": True, "drop": True, "order by": False, "limit 1": False})


def test_messages_and_accessors(spark):
    df = spark.createDataFrame([("files_changed", "a" * 9, "b" * 9, 2, 0, 1), ("new_commits", "a" * 9, "b" * 9, 0, 0, 0), ("not_indexed", None, None, 0, 0, 0), ("", "", "", 0, 0, 0)], "r string, l string, c string, a int, m int, d int")
    got = [r[0] for r in df.select(S.staleness_message(*map(F.col, "rlcamd"))).collect()]
    assert got == ["Index outdated: 2 added, 1 deleted since last index. Consider re-indexing.", "Index outdated: branch has new commits (indexed: aaaaaaa, current: bbbbbbb). Consider re-indexing.", "Index not found. Run index_repository to build the index.", ""]
    one = spark.range(1)
    lit = F.lit
    got = one.select(S.is_getter(lit("getX"), lit(False), lit(0), lit(1), lit(1), lit(2)), S.is_getter(lit("get"), lit(False), lit(0), lit(1), lit(1), lit(2)), S.is_getter(lit("isOk"), lit(False), lit(0), lit(1), lit(1), lit(4)), S.is_setter(lit("setX"), lit(False), lit(1), lit(True), lit(1), lit(2))).first()
    assert tuple(got) == (True, False, False, True)
    pair = one.select(S.route_of_annotations(F.array(lit("A"), lit("PutMapping"), lit("GetMapping")), F.array(lit("x"), lit("/p"), lit("/g"))).alias("r")).first()["r"]
    assert tuple(pair) == ("PUT", "/p")


def test_route_matching(spark):
    routes = [("r1", "GET", "/users/{id}", "spring"), ("r2", "POST", "/users/{id}", "spring"), ("r3", "GET", "/files/**", "spring"), ("r4", "getUser", "UserService", "grpc"), ("r5", "", "/any", "gin"), ("r6", "get", "/docs/[...slug]", "next"), ("r7", "m", "com.X", "dubbo"), ("r8", "GET", "/{all}/x", "spring")]
    calls = [("GET", "/users/7"), ("", "/users/{param}"), ("GET", "/files/a/b"), ("GET", "/files"), ("GETUSER", "userservice"), ("PUT", "/any"), ("GET", "/docs"), ("M", "com.X"), ("M", "com.x"), ("GET", "/{id}/x"), ("GET", "/none/y/z"), ("GET", None)]
    got = match_routes(spark.createDataFrame(calls, "method string, path string"), spark.createDataFrame([(*r, 1) for r in routes], "id string, method string, path string, framework string, n int"))
    assert {(r.method, r.path): r.route_id for r in got.collect()} == {
        ("GET", "/users/7"): "r1", ("", "/users/{param}"): "r1", ("GET", "/files/a/b"): "r3", ("GET", "/files"): "r3", ("GETUSER", "userservice"): "r4", ("PUT", "/any"): "r5", ("GET", "/docs"): "r6", ("M", "com.X"): "r7", ("GET", "/{id}/x"): "r1",
    }
    assert match_routes(spark.createDataFrame([], "method string, path string"), spark.createDataFrame([], "id string, method string, path string, framework string")).count() == 0


def test_argument_types(spark):
    links = spark.createDataFrame([("Integer", "Number"), ("Number", "Object"), ("A", "B"), ("B", "A")], "child string, parent string")
    closure = overloads.type_closure(spark, links)
    assert {(r.child, r.parent): r.depth for r in closure.where("child = 'Integer'").collect()} == {("Integer", "Integer"): 0, ("Integer", "Number"): 1, ("Integer", "Object"): 2}
    types = overloads.compatible(spark, closure)
    rows = [
        (1, "num", ["Number"], ["int"], []), (1, "obj", ["Object"], ["int"], []), (1, "str", ["String"], ["int"], []),  # the nearest supertype
        (2, "s", ["String"], ["Foo"], []), (2, "i", ["int"], ["Foo"], []),  # none fits: all stay
        (3, "one", ["String"], ["!String"], []), (3, "other", ["Code"], ["!String"], []),
        (4, "fixed", ["Object"], ["null"], []), (4, "var", ["Object..."], ["null"], []),
        (5, "t", ["T"], ["Foo"], ["T"]), (5, "exact", ["Foo"], ["Foo"], []),
        (6, "two", ["int", "int"], ["int"], []), (6, "v", ["int", "String..."], ["int"], []),
    ]
    df = spark.createDataFrame(rows, "call_id int, id string, params array<string>, arguments array<string>, generics array<string>")
    got = {(r.call_id, r.id) for r in overloads.by_argument_types(df, types).collect()}
    assert got == {(1, "num"), (2, "s"), (2, "i"), (3, "other"), (4, "fixed"), (5, "exact"), (6, "v")}
    assert overloads.by_argument_types(df.limit(0), types).count() == 0


def test_closure_follows_asked_types_only(spark):
    """Of a wide hierarchy only the supertypes of types that calls name are worked out; the choice stays as with all."""
    wide = [(f"L{k}N{i}", f"L{k + 1}N{j}") for k in range(4) for i in range(6) for j in range(6)]
    links = spark.createDataFrame([*wide, ("Integer", "Number"), ("Number", "Object")], "child string, parent string")
    rows = [(1, "far", ["L4N0"], ["L1N2"], []), (1, "near", ["L2N5..."], ["L1N2"], []), (1, "no", ["L0N0"], ["L1N2"], []), (2, "box", ["Number"], ["int"], []), (2, "no", ["L3N3"], ["int"], []), (3, "none", [], [], []), (3, "some", ["L3N3"], [], [])]
    df = spark.createDataFrame(rows, "call_id int, id string, params array<string>, arguments array<string>, generics array<string>")
    asked = overloads.type_closure(spark, links, 32, *overloads.asked_types(spark, df))
    assert {tuple(r) for r in asked.where("depth > 0").collect()} == {("L1N2", "L2N5", 1), ("L1N2", "L3N3", 2), ("L1N2", "L4N0", 3), ("Integer", "Number", 1)}
    every = overloads.type_closure(spark, links)
    assert every.count() == 30 + 6 * 6 * 10 + 3 + 3
    chosen = [{tuple(r) for r in overloads.by_argument_types(df, overloads.compatible(spark, c)).collect()} for c in (asked, every)]
    assert chosen[0] == chosen[1] == {(1, "near"), (2, "box"), (3, "none")}


def test_overrides_through_tables(spark, data, tmp_path):
    """j16 on tables that hold an override two levels up, against its SQL."""
    import duckdb

    from skein.queries import all_oracle_sql, all_queries

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    added = {
        "class_nodes": "select * replace ('k' || n as id, 'K' || n as name, 'p.K' || n as qualified_name, 'p/k.py' as file_path) from (select * from '{0}' limit 1), range(3) t(n)",
        "function_nodes": "select * exclude (n) replace ('f' || n as id, 'run' as name, 'p.K' || n || '.run' as qualified_name, false as is_constructor, null as deleted_at, now()::timestamptz as indexed_at, '[]' as params) from (select * from '{0}' where indexed_at is not null limit 1), (values (0), (2)) t(n)",
        "edges": "select * exclude (n) replace (-n as edge_id, 'k' || n as source_id, 'k' || (n - 1) as target_id, 'EXTENDS' as kind) from (select * from '{0}' where kind = 'EXTENDS' limit 1), (values (1), (2)) t(n)",
    }
    added["class_nodes"] = added["class_nodes"].replace("select * replace", "select * exclude (n) replace")
    for name in ("class_nodes", "function_nodes", "edges"):
        source = f"{data}/{name}.parquet"
        con.execute(f"copy (select * from '{source}' union all by name {added[name].format(source)}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = {tuple(r) for r in all_queries()["j16_overrides"](spark, str(tmp_path)).select("kind", "src", "dst").collect()}
    assert {("OVERRIDES", "f2", "f0"), ("DISPATCHES", "f0", "f2")} <= got
    assert got == set(con.execute(f"select kind, src, dst from ({all_oracle_sql()['j16_overrides']})").fetchall())
