"""Traversal and sub-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.lens import view, with_views
from skein.operators import modes
from skein.operators.traverse import Subgraph, ancestors, call_chain, owned_chain, reachable_sizes, truncated
from skein.storage import Scratch

DEPTH, CONFIDENCE = 3, 0.7
ROOTS = 5


def busiest(spark: SparkSession, sf_dir: str, end: str = "src") -> DataFrame:
    """The functions with most sure calls (a top-k by design): roots of the traversal queries."""
    calls = view(spark, sf_dir, "call_edge").where(F.col("confidence") >= CONFIDENCE)
    return calls.groupBy(F.col(end).alias("id")).count().orderBy(F.desc("count"), "id").limit(ROOTS).select("id")


def _chain(spark: SparkSession, sf_dir: str, reverse: bool = False, confidence: float = CONFIDENCE) -> Subgraph:
    fn, calls, sent = (view(spark, sf_dir, v) for v in ("fn", "call_edge", "dispatch_edge"))
    return call_chain(fn, calls, sent, busiest(spark, sf_dir, "dst" if reverse else "src"), DEPTH, reverse, confidence)


def _sql(reverse: bool = False, confidence: float = CONFIDENCE, depth: int = DEPTH) -> str:
    """The same two-phase levels written out, for another engine."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    ok = f"(confidence is null or confidence >= {confidence})"
    parts = [
        f"roots as (select {near} id from call_edge where confidence >= {CONFIDENCE} group by 1 order by count(*) desc, 1 limit {ROOTS})",
        "v0 as (select id root, id from roots)", "f0 as (select * from v0)",
    ]
    for k in range(1, depth + 1):
        p = k - 1
        parts += [
            f"c{k} as (select f.root, e.src, e.dst, 'CALLS' kind, {k} lvl, e.line, e.confidence, e.declared_type, e.chain_id, e.chain_depth from call_edge e join f{p} f on e.{near} = f.id where {ok})",
            f"n{k} as (select distinct root, {far} id from c{k} where (root, {far}) not in (select (root, id) from v{p}))",
            f"t{k} as (select distinct c.root, c.{far} id, declared_type || '.' pre, starts_with(fn.qualified_name, declared_type || '.') own from c{k} c join fn on fn.id = c.{far} where declared_type <> '')",
            f"d{k} as (select n.root, e.src, e.dst, 'DISPATCHES' kind, {k} lvl, null::int line, e.confidence, null::varchar declared_type, null::int chain_id, null::int chain_depth from dispatch_edge e join n{k} n on e.{near} = n.id join fn o on o.id = e.{far} where {ok} and (not exists (select 1 from t{k} t where t.root = n.root and t.id = n.id) or exists (select 1 from t{k} t where t.root = n.root and t.id = n.id and (t.own or starts_with(o.qualified_name, t.pre)))))",
            f"m{k} as (select distinct root, {far} id from d{k} where (root, {far}) not in (select (root, id) from v{p}) and (root, {far}) not in (select (root, id) from n{k}))",
            f"f{k} as (select * from n{k} union all select * from m{k})",
            f"v{k} as (select * from v{p} union all select * from f{k})",
        ]
    parts.append("nodes as (" + " union all ".join(f"select root, id, {k} lvl from f{k}" for k in range(1, depth + 1)) + ")")
    parts.append("edges_ as (" + " union all ".join(f"select * from c{k} union all select * from d{k}" for k in range(1, depth + 1)) + ")")
    return "with " + ",\n".join(parts) + "\n"


_NODES, _EDGES = "select root, id, cast(lvl as int) level from nodes", "select root, src, dst, kind, cast(lvl as int) as \"level\", coalesce(line, -1) line, confidence from edges_"


def t01_call_chain_forward(spark, sf_dir):
    return _chain(spark, sf_dir).nodes


def t01_call_chain_edges(spark, sf_dir):
    return _chain(spark, sf_dir).edges.select("root", "src", "dst", "kind", "level", F.coalesce("line", F.lit(-1)).alias("line"), "confidence")


def t01_call_chain_reverse(spark, sf_dir):
    return _chain(spark, sf_dir, reverse=True).nodes


def t02_truncated(spark, sf_dir):
    fn, calls, sent = (view(spark, sf_dir, v) for v in ("fn", "call_edge", "dispatch_edge"))
    return truncated(_chain(spark, sf_dir), fn, calls, sent, CONFIDENCE)


def t04_impact(spark, sf_dir):
    """Reverse chain without a confidence limit."""
    return _chain(spark, sf_dir, reverse=True, confidence=0.0).nodes


def t05_route_chain(spark, sf_dir):
    """Functions behind the asked routes (every one whose key is divisible by 100), ten levels deep: the last handler is
    the business one, others are middleware."""
    return _route_chain(spark, sf_dir, view(spark, sf_dir, "route").where("k % 100 = 0"), 10)


def _route_chain(spark: SparkSession, sf_dir: str, route: DataFrame, depth: int) -> DataFrame:
    handles = view(spark, sf_dir, "handles")
    last = handles.groupBy("dst").agg(F.max_by("src", "handler_order").alias("handler"), F.max("handler_order").alias("top"))
    chosen = route.select(F.col("id").alias("route_id")).join(last.withColumnRenamed("dst", "route_id"), "route_id")
    fn, calls, sent = (view(spark, sf_dir, v) for v in ("fn", "call_edge", "dispatch_edge"))
    found = owned_chain(fn, calls, sent, chosen.select(F.col("route_id").alias("owner"), F.col("handler").alias("id")), depth).withColumnRenamed("owner", "route_id")
    return found.unionByName(chosen.select("route_id", F.col("handler").alias("id"), F.lit(0).alias("level")))


T05_SQL = _sql(confidence=0.0, depth=10).replace(f"roots as (select src id from call_edge where confidence >= {CONFIDENCE} group by 1 order by count(*) desc, 1 limit {ROOTS})", "chosen as (select r.id route_id, arg_max(h.src, h.handler_order) handler from route r join handles h on h.dst = r.id where r.k % 100 = 0 group by 1),\nroots as (select distinct handler id from chosen)") + "select route_id, id, lvl as \"level\" from chosen join nodes on nodes.root = handler union all select route_id, handler, 0 from chosen"


def t05_middleware(spark, sf_dir):
    handles = view(spark, sf_dir, "handles")
    top = handles.groupBy("dst").agg(F.max("handler_order").alias("top"))
    return handles.join(top, "dst").where("handler_order < top").select(F.col("dst").alias("route_id"), F.col("src").alias("middleware"), "handler_order")


def t06_cross_chain(spark, sf_dir):
    """Calls out of a project reached from the roots, by target project."""
    fn = view(spark, sf_dir, "fn")
    edges = _chain(spark, sf_dir).edges.where("kind = 'CALLS'")
    ends = edges.join(fn.select(F.col("id").alias("src"), F.col("source_project").alias("a")), "src").join(fn.select(F.col("id").alias("dst"), F.col("source_project").alias("b")), "dst").where("a <> b")
    return ends.groupBy("root", F.col("b").alias("target_project")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("callers"), F.count(F.lit(1)).alias("n_calls"))


def t07_method_in_hierarchy(spark, sf_dir):
    """For each class and method name among its ancestors: the nearest definition."""
    cls, fn = view(spark, sf_dir, "cls"), view(spark, sf_dir, "fn")
    up = ancestors(view(spark, sf_dir, "extends_edge"), 5, Scratch(spark))
    owner = fn.select(F.expr("regexp_replace(qualified_name, '\\\\.[^.]*$', '')").alias("owner"), "name", F.col("id").alias("method_id"))
    own = cls.select(F.col("id").alias("ancestor"), F.col("qualified_name").alias("owner")).join(owner, "owner")
    found = up.join(own, "ancestor").groupBy("id", "name").agg(F.min(F.struct("level", "method_id")).alias("m"))
    return found.select(F.col("id").alias("class_id"), "name", F.col("m.level").alias("level"), F.col("m.method_id").alias("method_id"))


T07_SQL = """with recursive up as (select src id, dst ancestor, 1 lvl from extends_edge union all select u.id, e.dst, lvl + 1 from up u join extends_edge e on e.src = u.ancestor where lvl < 5),
near as (select id, ancestor, min(lvl) lvl from up where id <> ancestor group by all),
own as (select c.id ancestor, f.name, f.id method_id from cls c join fn f on regexp_replace(f.qualified_name, '\\.[^.]*$', '') = c.qualified_name),
r as (select n.id class_id, name, lvl as "level", method_id, row_number() over (partition by n.id, name order by lvl, method_id) rn from near n join own on own.ancestor = n.ancestor)
select class_id, name, cast("level" as int) as "level", method_id from r where rn = 1"""


def t10_ancestry(spark, sf_dir):
    return ancestors(view(spark, sf_dir, "extends_edge"), 5, Scratch(spark)).select("id", "ancestor", "level")


T10_SQL = """with recursive up as (select src id, dst ancestor, 1 lvl from extends_edge union all select u.id, e.dst, lvl + 1 from up u join extends_edge e on e.src = u.ancestor where lvl < 5)
select id, ancestor, cast(min(lvl) as int) as "level" from up where id <> ancestor group by 1, 2"""


def t11_topological_levels(spark, sf_dir):
    """Longest-path level of each class of the inheritance graph; -1 on and behind cycles."""
    return reachable_sizes(view(spark, sf_dir, "extends_edge"), Scratch(spark)).fillna(-1, ["level"])


T11_SQL = """with recursive n as (select src id from extends_edge union select dst from extends_edge),
walk as (select id, 0 lvl from n where id not in (select dst from extends_edge) union select e.dst, w.lvl + 1 from walk w join extends_edge e on e.src = w.id where w.lvl < 500),
reach as (select src a, dst b from extends_edge union select r.a, e.dst from reach r join extends_edge e on e.src = r.b)
select n.id, case when n.id in (select b from reach x where exists (select 1 from reach y where y.a = x.a and y.b = x.a)) then -1 else (select cast(max(lvl) as int) from walk w where w.id = n.id) end as "level" from n"""


def t12_forest_degrees(spark, sf_dir):
    calls = view(spark, sf_dir, "call_edge")
    out, into = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")), calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return view(spark, sf_dir, "fn").select("id").join(out, "id", "left").join(into, "id", "left").fillna(0)


T12_SQL = "select id, coalesce(o, 0) out_degree, coalesce(i, 0) in_degree from fn left join (select src, count(*) o from call_edge group by 1) a on a.src = id left join (select dst, count(*) i from call_edge group by 1) b on b.dst = id"


def _nodes_with_props(spark, sf_dir):
    sub = _chain(spark, sf_dir)
    props = view(spark, sf_dir, "fn").select("id", "name", "qualified_name", "file_path", "is_getter", "is_setter", "is_constructor")
    return sub.nodes.join(props, "id"), sub.edges


def m01_core(spark, sf_dir):
    nodes, edges = modes.core(*_nodes_with_props(spark, sf_dir))
    return edges.select("root", "src", "dst", "kind", "level", F.coalesce("line", F.lit(-1)).alias("line"), "confidence")


M01_SQL = "gone as (select n.root, n.id from nodes n join fn on fn.id = n.id where is_getter or is_setter or coalesce(file_path, '') in ('', '[external]')) " + _EDGES + " e where not exists (select 1 from gone g where g.root = e.root and g.id in (e.src, e.dst))"


def m02_dry(spark, sf_dir):
    nodes, edges = _nodes_with_props(spark, sf_dir)
    return modes.dry(nodes, edges, Scratch(spark))[0].select("root", "id")


def m03_compact(spark, sf_dir):
    return modes.compact(_chain(spark, sf_dir).edges).select("root", "src", "dst", "kind", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "confidence")


M03_SQL = "select root, src, dst, kind, coalesce(array_to_string(list_sort(list(distinct line)), ','), '') \"lines\", max(confidence) confidence from edges_ group by 1, 2, 3, 4"


def m05_chains(spark, sf_dir):
    return modes.chains(_chain(spark, sf_dir).edges)


M05_SQL = """, u as (select distinct root, src, chain_id, chain_depth, dst from edges_ where kind = 'CALLS' and chain_id > 0)
select root, src, chain_id, string_agg(dst, '>' order by chain_depth, dst) steps, count(*) n_steps from u group by 1, 2, 3"""


def m07_edge_projection(spark, sf_dir):
    return view(spark, sf_dir, "call_edge").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("CALLS").alias("kind"), "line", "confidence", F.nullif(F.col("declared_type"), F.lit("")).alias("declared_type"))


def t13_process_trace(spark, sf_dir):
    """Pre-order steps of a depth-first trace from each root, every function once per root; calls below 0.5 are left
    out. Order of children: line, id. The visited set is global to a root, so a root's reach is traced in one group:
    it is bounded by the depth, and only `DEPTH` levels are gathered."""
    sub = _chain(spark, sf_dir, confidence=0.5)
    edges = sub.edges.where("kind = 'CALLS' and confidence >= 0.5").select("root", "src", "dst", F.coalesce("line", F.lit(0)).alias("line")).distinct()

    def trace(key, pdf):
        import pandas as pd

        children: dict = {}
        for r in pdf.sort_values(["line", "dst"]).itertuples():
            children.setdefault(r.src, []).append(r.dst)
        steps, seen, stack = [], {key[0]}, [(key[0], 0)]
        while stack:
            node, depth = stack.pop()
            if depth:
                if node in seen:
                    continue
                seen.add(node)
            steps.append((key[0], node, len(steps), depth))
            if depth < DEPTH:
                stack += [(c, depth + 1) for c in reversed(children.get(node, [])) if c not in seen]
        return pd.DataFrame(steps, columns=["root", "id", "seq", "depth"])

    return edges.groupBy("root").applyInPandas(trace, "root string, id string, seq int, depth int")


def queries() -> dict:
    return {f.__name__: f for f in (t01_call_chain_forward, t01_call_chain_edges, t01_call_chain_reverse, t02_truncated, t04_impact, t05_route_chain, t05_middleware, t06_cross_chain, t07_method_in_hierarchy, t10_ancestry, t11_topological_levels, t12_forest_degrees, t13_process_trace, m01_core, m02_dry, m03_compact, m05_chains, m07_edge_projection)}


def oracle_sql() -> dict:
    rest = "select src, dst, confidence from call_edge union all select src, dst, confidence from dispatch_edge"
    raw = {
        "t01_call_chain_forward": _sql() + _NODES,
        "t01_call_chain_edges": _sql() + _EDGES,
        "t01_call_chain_reverse": _sql(True) + _NODES,
        "t04_impact": _sql(True, 0.0) + _NODES,
        "t02_truncated": _sql() + f"select f.root, f.id, fn.qualified_name || ' (' || count(*) || ' direct callees not expanded)' text from f3 f join ({rest}) e on e.src = f.id join fn on fn.id = f.id where (e.confidence is null or e.confidence >= {CONFIDENCE}) and (f.root, e.dst) not in (select (root, id) from v3) group by f.root, f.id, fn.qualified_name",
        "t05_route_chain": T05_SQL,
        "t05_middleware": "select h.dst route_id, h.src middleware, h.handler_order from handles h where handler_order < (select max(handler_order) from handles x where x.dst = h.dst)",
        "t06_cross_chain": _sql() + "select root, b.source_project target_project, string_agg(distinct e.src, ',' order by e.src) callers, count(*) n_calls from edges_ e join fn a on a.id = e.src join fn b on b.id = e.dst where kind = 'CALLS' and a.source_project <> b.source_project group by 1, 2",
        "t07_method_in_hierarchy": T07_SQL, "t10_ancestry": T10_SQL, "t11_topological_levels": T11_SQL, "t12_forest_degrees": T12_SQL,
        "m01_core": _sql().rstrip() + ", " + M01_SQL,
        "m03_compact": _sql() + M03_SQL,
        "m05_chains": _sql().rstrip() + M05_SQL,
        "m07_edge_projection": "select src source, dst target, 'CALLS' kind, line, confidence, nullif(declared_type, '') declared_type from call_edge",
    }
    return {k: with_views(v) for k, v in raw.items()}
