"""Index, definitions, entry points and processes as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view, with_views
from skein.operators import forest, modes
from skein.operators.traverse import call_chain, truncated
from skein.queries import analysis, graph
from skein.sources import definition_facts as D
from skein.sources import index as I
from skein.sources.extract import file_facts
from skein.sources.store import GraphStore
from skein.storage import Scratch, read_table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


def _files(spark, sf):
    return read_table(spark, sf, "files").select("rel_path", "content", "mod_time", "source_project")


_TEST_NAME = "case regexp_extract(p, '\\.([^./]+)$', 1) when 'go' then ends_with(p, '_test.go') when 'java' then ends_with(p, 'Test.java') or ends_with(p, 'Tests.java') or ends_with(p, 'Spec.java') when 'py' then starts_with(string_split(p, '/')[-1], 'test_') or ends_with(p, '_test.py') else ends_with(p, '.test.ts') or ends_with(p, '.test.js') or ends_with(p, '.spec.ts') or ends_with(p, '.spec.js') end"
_SCAN = f"""select p rel_path, case when regexp_extract(p, '\\.([^./]+)$', 1) not in ('java', 'go', 'py', 'ts', 'js') then 'language' when list_has_any(string_split(p, '/')[:-2], {list(S.IGNORED_DIRECTORIES)}) then 'ignored'
 when list_has_any(string_split(p, '/')[:-2], {list(S.TEST_DIRECTORIES)}) or (ends_with(p, '.java') and contains(p, 'src/test/')) or {_TEST_NAME} then 'test' when octet_length(c) > 2097152 then 'size' else '' end skipped from (select rel_path p, max_by(content, (mod_time, content)) c from files where rel_path is not null group by 1)"""


@query(_SCAN)
def s02_source_scan(spark, sf):
    """Files with the reason why they are not indexed."""
    return I.source_scan(_files(spark, sf)).where("rel_path is not null").select("rel_path", "skipped")


@query("""with x as (select *, length(rel_path) % 11 no from files), o as (select rel_path p, max(mod_time) m, max(size) s from x where no <> 0 group by 1), n as (select rel_path p, max(mod_time) m, max(size + case when no = 1 then 1 else 0 end) s from x where no <> 2 group by 1),
c as (select case when o.p is null then 'added' when n.p is null then 'deleted' else 'modified' end status from o full join n on o.p = n.p where o.p is null or n.p is null or o.m is distinct from n.m or o.s is distinct from n.s)
select count(*) filter (status = 'added') added, count(*) filter (status = 'modified') modified, count(*) filter (status = 'deleted') deleted, count(*) > 0 stale from c""")
def j04_change_counts(spark, sf):
    """How many files were added, modified and deleted, and whether the index is stale; one row."""
    from skein.queries.joins import j03_changed_files

    return I.change_counts(j03_changed_files(spark, sf))


def c33_import_targets(spark, sf):
    """File that each import means; tests have a table of cases."""
    facts = file_facts(read_table(spark, sf, "files").select("rel_path", "content").distinct())
    imports = facts.where("fact = 'import'").select("file_path", F.col("parent").alias("module"))
    return I.import_targets(imports, read_table(spark, sf, "files").select(F.col("rel_path").alias("path")).distinct())


def n09_full_index(spark, sf):
    """Facts per kind after a full index."""
    store = GraphStore(spark, Scratch(spark).base)
    I.full_index(store, _files(spark, sf), "main", 1)
    return store.read("facts", "main").groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


def n10_incremental_index(spark, sf):
    """Files that an incremental index touches when the files of the last change time come to those before; tests compare
    the result with a full index."""
    store = GraphStore(spark, Scratch(spark).base)
    files = _files(spark, sf)
    last = files.agg(F.max("mod_time")).first()[0]
    I.full_index(store, files.where(F.col("mod_time").isNull() | (F.col("mod_time") < F.lit(last))), "main", 1)
    return I.incremental_index(store, files, "main", 2)


def s12_definitions(spark, sf):
    """Facts of build, mapper, protocol and schema files."""
    return D.definition_facts(_files(spark, sf))


def s01_project_types(spark, sf):
    return D.project_types(D.definition_facts(_files(spark, sf)))


def s13_frameworks(spark, sf):
    return D.project_frameworks(D.definition_facts(_files(spark, sf)))


for _f in (c33_import_targets, n09_full_index, n10_incremental_index, s12_definitions, s01_project_types, s13_frameworks):
    Q[_f.__name__] = _f

_N01 = analysis.SQL["n01_entry_points"]


@query()
def n04_entry_points_written(spark, sf):
    """Functions with the entry type and score that the analysis gives them; others keep theirs."""
    from skein.operators.lookups import apply_updates

    fn = view(spark, sf, "fn").select("id", "entry_type", F.lit(None).cast("double").alias("score"))
    return apply_updates(fn, analysis.n01_entry_points(spark, sf).select("id", F.col("kind").alias("entry_type"), "score"), ["entry_type", "score"])


SQL["n04_entry_points_written"] = with_views("select f.id, f.entry_type, f.id is null x from fn f").replace("select f.id, f.entry_type, f.id is null x from fn f", f"select f.id, coalesce(n.kind, f.entry_type) entry_type, n.score from fn f left join ({_N01}) n on n.id = f.id")


@query()
def n05_processes(spark, sf):
    """Process nodes: entry points that are neither dead, unknown nor mere implementations of an interface."""
    e = analysis.n01_entry_points(spark, sf).where("kind not in ('suspected_dead', 'unknown', 'interface_impl')")
    return e.select(F.concat(F.lit("process:"), "id").alias("id"), F.col("id").alias("entry"), "kind")


SQL["n05_processes"] = f"select 'process:' || id id, id entry, kind from ({_N01}) n where kind not in ('suspected_dead', 'unknown', 'interface_impl')"


@query()
def n06_cleared(spark, sf):
    """Nodes that are left when the analysis is cleared: all but the processes."""
    nodes = view(spark, sf, "fn").select("id").unionByName(n05_processes(spark, sf).select("id"))
    return nodes.where(~F.col("id").startswith("process:"))


SQL["n06_cleared"] = with_views("select id from fn")


def t14_call_forest(spark, sf):
    """Edges of the trees below all entry points but the dead ones, two levels deep (the depth is an argument)."""
    return forest.call_forest(view(spark, sf, "fn"), view(spark, sf, "call_edge"), view(spark, sf, "dispatch_edge"), analysis.n01_entry_points(spark, sf), 2)


def t15_core_forest(spark, sf):
    """The same trees without accessors and external functions; tests compare with plain contraction."""
    scratch = Scratch(spark)
    return forest.core_forest(scratch.save(t14_call_forest(spark, sf)), view(spark, sf, "fn"), scratch)


def t03_call_chain_by_name(spark, sf):
    """Chains of every function that a name means: here of all constructors."""
    fn, calls, sent = (view(spark, sf, v) for v in ("fn", "call_edge", "dispatch_edge"))
    return call_chain(fn, calls, sent, fn.where("name = '__init__'").select("id"), graph.DEPTH, False, graph.CONFIDENCE).nodes


SQL["t03_call_chain_by_name"] = with_views(graph._sql().replace(f"roots as (select src id from call_edge where confidence >= {graph.CONFIDENCE} group by 1 order by count(*) desc, 1 limit {graph.ROOTS})", "roots as (select id from fn where name = '__init__')") + graph._NODES)


def m04_declared_type(spark, sf):
    """Callers of the busiest functions through the type their calls declare most, and what lies above them."""
    edges = Scratch(spark).save(graph._chain(spark, sf, reverse=True, confidence=0.0).edges)
    declared = edges.where("level = 1 and dst = root and declared_type <> ''").groupBy("declared_type").count().orderBy(F.desc("count"), "declared_type").first()
    return modes.declared_type_only(edges, declared[0] if declared else "").select("root", "src", "dst", "kind", "level").distinct()


def m06_truncated(spark, sf):
    """The truncation report without the functions that the core filter leaves out."""
    sub = graph._chain(spark, sf)
    fn, calls, sent = (view(spark, sf, v) for v in ("fn", "call_edge", "dispatch_edge"))
    gone = fn.where(F.col("is_getter") | F.col("is_setter") | F.coalesce("file_path", F.lit("")).isin("", "[external]")).select("id")
    return truncated(sub, fn, calls, sent, graph.CONFIDENCE).join(gone, "id", "left_anti")


for _f in (t14_call_forest, t15_core_forest, t03_call_chain_by_name, m04_declared_type, m06_truncated):
    Q[_f.__name__] = _f


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL
