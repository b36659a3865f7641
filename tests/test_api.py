"""Every tool answers with its arguments; small facts about the answers."""

import pytest
from pyspark.sql import functions as F

from skein.api import Tools
from skein.lens import view
from skein.sources.store import GraphStore


@pytest.fixture(scope="module")
def tools(spark, data):
    return Tools(spark, data)


def test_lookups(tools, spark, data):
    fn = view(spark, data, "fn")
    one = fn.orderBy("id").first()
    assert one.id in {r.id for r in tools.query_symbol(one.qualified_name).collect()}
    assert one.id in {r.id for r in tools.search(one.qualified_name, limit=0).collect()}
    assert {r.id for r in tools.find_functions(one.qualified_name).collect()} >= {one.id}
    page = tools.search("a", limit=7, offset=3).collect()
    assert len(page) == 7 and page[0].total == tools.search("a", limit=0).count()
    cls = view(spark, data, "cls").orderBy("id").first()
    assert {r.class_id for r in tools.query_class_members(cls.qualified_name).collect()} <= {cls.id}
    got = tools.locate_function([(one.file_path, one.start_line), ("none", 1)]).collect()
    assert {r.file_path: r.id is not None for r in got} == {one.file_path: True, "none": False}
    for df in (tools.list_projects(), tools.overview(), tools.query_by_annotation("Service"), tools.query_by_layer("service"), tools.query_dependencies(one.name), tools.query_usages("Segment"), tools.query_entry_points()):
        df.collect()


def test_chains(tools, spark, data):
    e = view(spark, data, "call_edge").join(view(spark, data, "fn").select(F.col("id").alias("src"), "qualified_name"), "src").orderBy("edge_id").first()
    full = tools.query_call_chain(e.qualified_name, mode="full")
    assert (e.src, e.dst) in {(r.src, r.dst) for r in full.collect()}
    for mode in ("core", "dry", "compact"):
        assert tools.query_call_chain(e.qualified_name, mode=mode).count() <= full.count()
    assert tools.query_call_chain("no.such.name").count() == 0
    with pytest.raises(ValueError):
        tools.query_call_chain("x", mode="thin")
    assert e.src in {r.id for r in tools.impact_analysis(view(spark, data, "fn").where(F.col("id") == e.dst).first().qualified_name).collect()}
    tools.query_cross_chain(e.qualified_name).collect()
    tools.truncated_nodes(e.qualified_name, 1).collect()


def test_routes_and_forest(tools, spark, data):
    r = tools.query_routes("GET").orderBy("id").first()
    assert r.method == "GET" and tools.match_route("GET", r.path).count() == 1 and tools.query_routes(type="cli").where("method <> 'CLI'").count() == 0
    handled = view(spark, data, "handles").join(tools.query_routes(type="all").select(F.col("id").alias("dst"), "path"), "dst").first()
    assert tools.query_route_chain(handled.path, max_depth=1).count() > 0
    full = tools.query_call_forest(depth=1, mode="full")
    assert tools.query_call_forest(depth=1).select("src").distinct().count() <= full.count()


def test_index(tools, spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    assert tools.check_index_status(store, "main").first().message.startswith("Index not found")
    assert tools.index_repository(store, "main", 1).count() > 0
    assert tools.check_index_status(store, "main").first().stale is False and tools.index_repository(store, "main", 2).count() == 0
