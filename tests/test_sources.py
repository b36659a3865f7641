"""Extraction, definition files, graph tables and streaming forms."""

from skein.sources import definitions as D
from skein.sources.extract import brace_facts, file_facts, python_facts
from skein.sources.store import GraphStore
from skein.streaming.windows import hourly_counts

JAVA = """package a.b;
import x.y.Z;
public class Foo extends Base implements One, Two {
  Foo() { super(); }
  @Get("/{x") public int bar(int a, String b) throws E { helper.call(a, f(b)); return 1; }
}
"""
GO = 'package p\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tBase\n\tx int\n}\n\nfunc (t *T) Run(a, b int) error {\n\tfmt.Println(a)\n\treturn nil\n}\n'
TS = "import { q } from './m';\nexport class A extends B {\n  async run(x: number): Promise<void> { this.go(x); }\n}\nexport function f(a, b) { q(a); }\nconst g = (a: number) => { f(a, 1); };\n"


def names(rows, fact):
    return {r[2] for r in rows if r[0] == fact}


def test_facts_of_each_language():
    j = brace_facts("java", "p/Foo.java", JAVA)
    assert names(j, "function") == {"a.b.Foo.Foo", "a.b.Foo.bar"} and names(j, "class") == {"a.b.Foo"}
    assert {(r[0], r[5]) for r in j if r[0] in ("extends", "implements", "import")} == {("extends", "Base"), ("implements", "One"), ("implements", "Two"), ("import", "x.y.Z")}
    assert {(r[1], r[5], r[6]) for r in j if r[0] == "call"} >= {("call", "helper", "2"), ("f", "", "1")}
    g = brace_facts("go", "p/t.go", GO)
    assert names(g, "function") == {"p.t.T.Run"} and {r[5] for r in g if r[0] == "embedding"} == {"Base"} and {r[5] for r in g if r[0] == "import"} == {"fmt"}
    t = brace_facts("typescript", "w/a.ts", TS)
    assert names(t, "function") == {"w.a.A.run", "w.a.f", "w.a.g"}
    p = python_facts("m/k.py", "import os\nclass A(B):\n    def f(self, x):\n        return os.path.join(x)\n")
    assert names(p, "function") == {"m.k.A.f"} and ("call", "join", "m.k.A.f", 4, 4, "os.path", "1") in p
    assert python_facts("m/k.py", "def f(") == []


def test_imports_and_headers_of_any_length():
    many = [f"name{i}" for i in range(60)]
    text = "import {\n" + ",\n".join(many) + ",\n} from './wide';\nimport type D, * as all from 'm'\nimport './side'\nconst u = import.meta.url\nclass A { go() { return 1; } }\n"
    rows = brace_facts("typescript", "w/a.ts", text)
    assert {r[1] for r in rows if r[0] == "import" and r[5] == "./wide"} >= set(many) and not [r for r in rows if r[0] == "import" and not r[5]]
    assert {r[5] for r in rows if r[0] == "import"} == {"./wide", "m", "./side"} and names(rows, "class") == {"w.a.A"}
    plain = brace_facts("typescript", "w/a.ts", "import { a, b } from './m'\n")
    assert {r[1] for r in rows if r[0] == "import" and r[5] == "./wide"} - set(many) == {r[1] for r in plain} - {"a", "b"}
    thrown = ", ".join(f"a.b.E{i}" for i in range(20))
    j = brace_facts("java", "p/Foo.java", "package a;\nimport x.Y\npublic class Foo {\n  void run(int x) throws " + thrown + " { go(); }\n  Map<K, V> of() { return null; }\n}\n")
    assert names(j, "function") == {"a.Foo.run", "a.Foo.of"} and ("call", "go", "a.Foo.run") in {r[:3] for r in j} and names(j, "class") == {"a.Foo"}
    ret = "Map<" * 15 + "string" + ", A>" * 15
    t = brace_facts("typescript", "w/a.ts", f"function f(a): {ret} {{ q(a); }}\n")
    assert names(t, "function") == {"w.a.f"} and ("call", "q", "w.a.f") in {r[:3] for r in t}


def test_file_facts_edge_cases(spark):
    df = spark.createDataFrame([("a.py", None, "n"), ("b.xyz", b"x", "n"), (None, b"x", "n"), ("c.java", b"", "n"), ("d.go", b"package p\nfunc (", "n")], "rel_path string, content binary, name string")
    assert file_facts(df).where("fact = 'function'").count() == 0


def test_definition_files():
    assert D.project_type(["package.json", "pom.xml"]) == ("maven", ["pom.xml", "package.json"])
    assert D.modules("pom.xml", "<modules><module>a</module><module> b </module></modules>") == ["a", "b"]
    assert D.modules("settings.gradle", "include ':a:b', ':c'") == ["a/b", "c"]
    assert D.modules("package.json", '{"workspaces": ["p/*"]}') == ["p/*"] and D.modules("package.json", "[") == []
    assert D.modules("go.work", "use (\n ./a\n ./b\n)") == ["a", "b"]
    assert D.frameworks(["spring-boot mybatis", "mybatis"]) == [("spring", "route"), ("mybatis", "orm")]
    assert D.mapper_queries('<mapper namespace="n.M"><select id="q">SELECT *\n FROM t <if test="x">WHERE a</if></select></mapper>') == [("n.M.q", "SELECT", "SELECT * FROM t WHERE a")]
    assert D.proto_services("service S { // c\n rpc A (X) returns (Y) {} rpc B(X) returns (Y); }") == [("S", "A"), ("S", "B")]
    assert D.graphql_operations("type Query {\n a(x: Int): T\n b: U\n}\ntype Other { c: T }") == [("Query", "a"), ("Query", "b")]
    assert D.type_text(D.type_tree("Map<String, List<User>>")) == "Map<String, List<User>>"
    assert D.last_dot_outside_parens("a.b(c.d)") == 1


def test_store_replaces_only_its_branch(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    df = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    store.write("n", df(("a", 1)), "main")
    store.write("n", df(("b", 2)), "dev")
    store.merge("n", df(("a", 5), ("c", 3)), "main", ["id"])
    store.append("n", df(("z", 9)), "dev")
    assert sorted(map(tuple, store.read("n", "main").collect())) == [("a", 5), ("c", 3)]
    assert sorted(map(tuple, store.read("n", "dev").collect())) == [("b", 2), ("z", 9)]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    q = hourly_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from hours").collect())) == sorted(map(tuple, hourly_counts(events).collect()))
