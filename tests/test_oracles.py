"""Every query with SQL against that SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from skein.queries import all_oracle_sql, all_queries

SLOW = {"t02_truncated", "t01_call_chain_edges", "t01_call_chain_reverse", "t04_impact", "t06_cross_chain", "m05_chains", "m01_core", "p2_hierarchy"}


def shown(frame):
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "~"
        if isinstance(x, pd.Timestamp):
            return str(x.tz_convert("UTC").tz_localize(None) if x.tzinfo else x)
        if isinstance(x, float):
            return repr(round(x, 6)) if x != int(x) else str(int(x))
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in r) for r in frame.astype(object).values.tolist())


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(data + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(all_oracle_sql()) - SLOW))
def test_query_equals_sql(spark, data, con, name):
    got, want = all_queries()[name](spark, data).toPandas(), con.execute(all_oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_library_stands_without_llm(tmp_path):
    """A copy without the llm folders still imports, and lists every other query."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    for p in (root / "skein").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "skein.llm" not in p.read_text()
    copy = tmp_path / "copy"
    shutil.copytree(root / "skein", copy / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(k.startswith('p9_') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(all_queries())), "False"], out.stderr[-2000:]
