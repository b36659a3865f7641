"""Function documentation: one fixture per language, doubtful comments, edge cases."""

import pytest

from skein.llm.doc_text import real_text
from skein.llm.function_docs import function_documentation

JAVA = '''package a.b;
/** License text. */
public class Foo {
  /**
   * Adds two numbers
   * and logs them.
   * @param x first
   */
  @Override
  @Named("a { b")
  public int add(int x, int y) { String s = "/** no */ void fake() {"; return x; }
  /* Not a doc comment but long enough to be one. */
  void plain() {}
  /** Builds the whole thing from many small parts. */
  Foo(String parts) {}
  /** Inner work happens in this place. */
  class In { /** Deep work that nobody sees. */ void deep() {} }
  /** Cut off by another comment. */
  // note
  void other() {}
}
'''
GO = '''package p

// Run starts the loop and waits for it.
//
//go:noinline
func (t *Tree) Run(a int) error {
	f := func() { }
	return nil
}

// Far away comment about something.

func Far() {}

/* Block starts the other loop. */
func Block() {}

// Next.
func Next() {}
'''
PY = '''"""Module text."""
class A:
    """Class text of some length."""
    def f(self, x: int = 1):
        """Return the shape of things."""
        def g():
            r"""Nested helper doing work."""
            return "def h(): pass"
        return g

    def __init__(self): "Prepare the inner state for later work."

    @x("""not doc""")
    async def k(self):
        # Return the answer to it all.
        return 1

    def z(self):
        f"""Formatted {self} is no doc."""

def one(): """Return one and only one."""; return 1
'''
TS = '''/** Draws a line between points. */
export const draw = (a: number): void => { const inner = () => { }; };
/** Keeps all values in order. */
export class C {
  /** Reads the next value from disk. */
  @Memo()
  async read<T>(k: T): Promise<{ a: T }> { log("}"); return `${k} {`; }
  /** Handler kept as a field. */
  h = () => {};
}
/** Top level function for parsing. */
export default function parse(s: string): string { return s; }
/** Number of things that exist. */
const n = 3;
'''


def pairs(spark, files):
    df = spark.createDataFrame([(p, "q", c.encode() if isinstance(c, str) else c, 0, "x") for p, c in files], "rel_path string, source_project string, content binary, pos int, doc string")
    return {(r.qualified_name, r.start_line): r for r in function_documentation(df).collect()}


def test_each_language(spark):
    got = pairs(spark, [("r/Foo.java", JAVA), ("r/t.go", GO), ("r/m.py", PY), ("r/d.ts", TS), ("r/m.py", PY)])
    java = {("a.b.Foo.add", 11), ("a.b.Foo.Foo", 15), ("a.b.Foo.In.deep", 17)}
    go = {("r.t.Tree.Run", 6), ("r.t.Block", 16)}
    py = {("r.m.A.f", 4), ("r.m.A.f.g", 6), ("r.m.A.__init__", 11), ("r.m.one", 21)}
    ts = {("r.d.draw", 2), ("r.d.C.read", 7), ("r.d.parse", 12)}
    assert set(got) == java | go | py | ts
    assert got[("a.b.Foo.add", 11)].documentation == "Adds two numbers and logs them." and got[("a.b.Foo.add", 11)].params == "int x, int y"
    assert got[("r.m.A.f", 4)].params == "self, x: int = 1"


def test_broken_null_and_empty_files_give_nothing(spark):
    assert pairs(spark, [("r/a.py", "def f():\n  '''Real words are here.'''\n  x = (\n"), ("r/b.py", None), ("r/c.java", ""), (None, "x")]) == {}


@pytest.mark.parametrize(
    "doc",
    ["/** */", "/** TODO: write docs */", "/** @param a\n * @return x */", "/** {@inheritDoc} */", "/** <p></p> */", "/** Copyright (c) 2020 The X. All rights\n * reserved. */", "/** Auto-generated method stub. */", "/** loadUserName */", "/** Loads the user name. */", "/** The load user name function. */", "/** eslint-disable */", "/** x.load(y, 2); */", "/** ------ */", "/** ... */", "/** N/A */", "/** (non-Javadoc) */"],
)
def test_no_documentation(doc):
    assert real_text(doc, "a.B.loadUserName", "block") == ""


@pytest.mark.parametrize("doc,style", [("/** Loads the name of a user from the cache. */", "block"), ("'''Returns what the caller asked for.'''", "string"), ("// loadUserName fetches a record by key.", "lines"), ("/** Reads it twice, if need be.\n * @return x */", "block")])
def test_documentation(doc, style):
    assert real_text(doc, "a.B.loadUserName", style)


def test_applied_verbs_count_as_the_name():
    assert real_text("/** Applys the rules. */", "a.applyRule", "block") == "" and real_text("// verifies link", "p.VerifyLink", "lines") == ""
