"""Store, full and incremental index, forests."""

import random

from pyspark.sql import functions as F

from skein.operators import forest
from skein.sources import index as I
from skein.sources.store import GraphStore, report
from skein.storage import Scratch


def files(spark, rows):
    return spark.createDataFrame([(p, c.encode(), t) for p, c, t in rows], "rel_path string, content binary, mod_time long")


FIRST = [("p/a.py", "from .b import g\ndef f():\n    g()\n", 1), ("p/b.py", "def g():\n    pass\n", 1), ("p/c.py", "def h():\n    pass\n", 1), ("p/tests/t.py", "def t(): pass\n", 1), ("p/x.txt", "x", 1), ("p/d.py", "import p.b\n", 1), ("p/gone.py", "def z(): pass\n", 1)]


def test_incremental_equals_full(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "one"))
    I.full_index(store, files(spark, FIRST), "main", 1, "p")
    assert {r.path for r in store.read("fingerprints", "main").collect()} == {"p/a.py", "p/b.py", "p/c.py", "p/d.py", "p/gone.py"}
    second = [("p/b.py", "def g2():\n    pass\n", 2) if p == "p/b.py" else (p, c, 2 if p == "p/c.py" else t) for p, c, t in FIRST if p != "p/gone.py"] + [("p/new.py", "def n(): pass\n", 2)]
    touched = {r.path: r.status for r in I.incremental_index(store, files(spark, second), "main", 2, "p").collect()}
    assert touched == {"p/b.py": "modified", "p/gone.py": "deleted", "p/new.py": "added", "p/a.py": "importer", "p/d.py": "importer"}  # c.py: new time, same content
    other = GraphStore(spark, str(tmp_path / "two"))
    I.full_index(other, files(spark, second), "main", 2)
    show = lambda s: sorted(tuple(r) for r in s.read("facts", "main").select("file_path", "fact", "name", "line").collect())
    assert show(store) == show(other)
    assert not store.exists("facts__next") and store.read("registry", "main").collect()[0].indexed_at == 2
    assert I.change_counts(I.classify_changes(store.read("fingerprints", "main"), store.read("fingerprints", "main"))).first().stale is False
    fresh = GraphStore(spark, str(tmp_path / "three"))
    assert I.incremental_index(fresh, files(spark, FIRST), "dev", 1).count() == 5


def test_scan_reasons(spark):
    rows = [("a/B.java", "x", 1), ("a/BTest.java", "x", 1), ("node_modules/a.js", "x", 1), ("a/big.go", "x" * 50, 1), ("a.txt", "x", 1), ("a/B.java", "y", 2)]
    got = {r.rel_path: (r.skipped, r.size) for r in I.source_scan(files(spark, rows), max_bytes=10).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a/B.java": "", "a/BTest.java": "test", "node_modules/a.js": "ignored", "a/big.go": "size", "a.txt": "language"}


def test_import_targets(spark):
    paths = ["p/src/a.ts", "p/src/util/index.ts", "p/lib/b.ts", "q/lib/b.ts", "p/m/__init__.py", "p/m/n.py", "p/java/com/x/Y.java"]
    imports = [("p/src/a.ts", "./util"), ("p/src/a.ts", "../lib/b"), ("p/src/a.ts", "lib/b"), ("p/m/n.py", "."), ("p/src/z.py", "m.n"), ("p/q/W.java", "com.x.Y"), ("p/src/a.ts", "nowhere"), ("p/src/a.ts", "")]
    got = I.import_targets(spark.createDataFrame(imports, "file_path string, module string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {(r.file_path, r.module): r.target for r in got.collect()} == {
        ("p/src/a.ts", "./util"): "p/src/util/index.ts", ("p/src/a.ts", "../lib/b"): "p/lib/b.ts", ("p/src/a.ts", "lib/b"): "p/lib/b.ts", ("p/m/n.py", "."): "p/m/__init__.py", ("p/src/z.py", "m.n"): "p/m/n.py", ("p/q/W.java", "com.x.Y"): "p/java/com/x/Y.java",
    }


def test_store_changes(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "id string, name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")
    assert store.migrate({"nodes": nodes.schema, "edges": edges.schema}) == ["nodes", "edges"] and store.migrate({"nodes": nodes.schema}) == []
    store.write("nodes", nodes, "m")
    store.write("edges", edges, "m")
    store.write("nodes", nodes.limit(1), "other")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    store.update("nodes", spark.createDataFrame([("c", "z"), ("a", None)], "id string, name string"), "m", ["name"])
    assert {tuple(r) for r in store.read("nodes", "m").collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    store.delete_edges("edges", ids("b"), "m")
    assert {tuple(r) for r in store.read("edges", "m").collect()} == {("a", "b"), ("c", "c")}
    store.delete("nodes", "edges", ids("a", None), "m")
    assert {r.id for r in store.read("nodes", "m").collect()} == {"b", "c"} and store.read("edges", "m").count() == 1
    store.delete("nodes", "edges", ids("b", "c"), "m")
    assert store.read("nodes", "m").count() == 0 and store.read("nodes", "other").count() == 1
    store.share("shared", spark.createDataFrame([("p", "m", 1), ("q", "m", 2)], "project string, branch string, v int"))
    store.share("shared", spark.createDataFrame([("p", "m", 3)], "project string, branch string, v int"))
    assert {(r.project, r.v) for r in spark.read.parquet(store.path("shared")).collect()} == {("p", 3), ("q", 2)}
    store.register("p", "/x", "m", 1)
    store.register("p", "/x", "m", 2)
    assert [r.indexed_at for r in store.read("registry", "m").collect()] == [2]
    store.dump(edges.withColumn("kind", F.lit("CALLS")), "dump", "kind")
    assert spark.read.option("header", True).csv(store.path("dump")).count() == 3
    js, md = report(spark.createDataFrame([("b", 2), ("a", 1)], "kind string, n int"))
    assert js.index('"a"') < js.index('"b"') and md.endswith("| b | 2 |")


def test_core_forest_against_plain_contraction(spark):
    rnd = random.Random(5)
    for turn in range(3):
        n = 9
        es = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(14)} if turn else {(0, 1), (1, 2), (2, 3), (3, 1), (2, 4), (4, 5)}
        drop = set(rnd.sample(range(n), 4)) if turn else {1, 2, 3}
        edges = spark.createDataFrame([("r", str(a), str(b)) for a, b in es], "root string, src string, dst string")
        fn = spark.createDataFrame([(str(i), i in drop, False, "f") for i in range(n)], "id string, is_getter boolean, is_setter boolean, file_path string")
        want = set()
        for a in set(range(n)) - drop:
            todo, seen = [b for x, b in es if x == a], set()
            while todo:
                b = todo.pop()
                if b in drop and b not in seen:
                    seen.add(b)
                    todo += [y for x, y in es if x == b]
                elif b not in drop and b != a:
                    want.add((str(a), str(b)))
        assert {(r.src, r.dst) for r in forest.core_forest(edges, fn, Scratch(spark)).collect()} == want


def test_tree_text():
    text = forest.call_tree_text("r", [("r", "b", 3), ("r", "a", 1), ("a", "b", 2), ("r", "a", 9), ("b", "r", 1)], {"r": "root"})
    assert text.splitlines() == ["root", "  a x2", "    b", "      root (see above)", "  b (see above)"]


def test_repository_source(spark, tmp_path):
    from skein.sources.repository import RepositorySource

    for path, text in (("a/b.py", "def f(): pass\n"), ("a/c.go", "package c\n"), ("node_modules/x.js", "1"), ("a/n.txt", "x"), ("big.ts", "x" * 99)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    spark.dataSource.register(RepositorySource)
    got = {r.rel_path: (r.language, r.size, r.content is None) for r in spark.read.format("repository").option("maxBytes", "50").load(str(tmp_path)).collect()}
    assert got == {"a/b.py": ("python", 14, False), "a/c.go": ("go", 10, False), "big.ts": ("typescript", 99, True)}
    (tmp_path / "none").mkdir()
    assert spark.read.format("repository").load(str(tmp_path / "none")).count() == 0
