"""Whole-graph analysis and call resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view, with_views
from skein.operators.resolve import export_closure, fixpoint_types, resolve_calls
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


_SCORES = {"http_handler": 0.95, "cli_handler": 0.95, "remote_client": 0.90, "annotation": 0.85, "main": 0.80, "interface_impl": 0.70, "unknown": 0.50, "suspected_dead": 0.30}
_CASE = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in _SCORES.items()) + " end"


@query(f"""with indeg as (select dst id from call_edge group by 1), outdeg as (select src id from call_edge group by 1), h as (select h.src id, max(case when r.framework in ('feign', 'grpc') then 2 when r.method in ('CLI', 'TOOL') then 0 else 1 end) k from handles h join route r on r.id = h.dst group by 1),
impl as (select distinct child_name n from heritage where kind = 'implements'),
k as (select f.id, case when h.k = 2 then 'remote_client' when h.k = 0 then 'cli_handler' when h.k = 1 then 'http_handler' when f.entry_type = 'event_listener' then 'annotation' when f.name in ('main', 'Main') then 'main'
 when len(string_split(f.qualified_name, '.')) >= 2 and string_split(f.qualified_name, '.')[-2] in (select n from impl) then 'interface_impl' when f.id not in (select id from outdeg) then 'suspected_dead' else 'unknown' end kind
 from fn f left join h on h.id = f.id where f.id not in (select id from indeg) or h.id is not null)
select id, kind, cast({_CASE} as double) score from k""")
def n01_entry_points(spark, sf):
    """Functions without callers and all route handlers, classified by the first rule that fits."""
    fn, calls = view(spark, sf, "fn").select("id", "name", "qualified_name", "entry_type"), view(spark, sf, "call_edge")
    into, out = calls.select(F.col("dst").alias("id"), F.lit(1).alias("called")).distinct(), calls.select(F.col("src").alias("id"), F.lit(1).alias("calling")).distinct()
    weight = F.when(F.col("framework").isin("feign", "grpc"), 2).when(F.col("method").isin("CLI", "TOOL"), 0).otherwise(1)
    handlers = view(spark, sf, "handles").join(view(spark, sf, "route").select(F.col("id").alias("dst"), "framework", "method"), "dst").groupBy(F.col("src").alias("id")).agg(F.max(weight).alias("h"))
    impl = read_table(spark, sf, "heritage").where("kind = 'implements'").select(F.col("child_name").alias("class_name"), F.lit(1).alias("impl")).distinct()
    segments = F.split("qualified_name", r"\.")
    j = fn.join(into, "id", "left").join(out, "id", "left").join(handlers, "id", "left").where("called is null or h is not null")
    j = j.withColumn("class_name", F.when(F.size(segments) >= 2, F.element_at(segments, -2))).join(impl, "class_name", "left")
    kind = (
        F.when(F.col("h") == 2, "remote_client").when(F.col("h") == 0, "cli_handler").when(F.col("h") == 1, "http_handler").when(F.col("entry_type") == "event_listener", "annotation")
        .when(F.col("name").isin("main", "Main"), "main").when(F.col("impl") == 1, "interface_impl").when(F.col("calling").isNull(), "suspected_dead").otherwise("unknown")
    )
    score = F.create_map(*[x for k, v in _SCORES.items() for x in (F.lit(k), F.lit(v))])
    return j.select("id", kind.alias("kind")).select("id", "kind", score[F.col("kind")].alias("score"))


@query("select distinct f.id from fn f join heritage h on h.kind = 'implements' and len(string_split(f.qualified_name, '.')) >= 2 and string_split(f.qualified_name, '.')[-2] = h.child_name")
def n02_interface_impl(spark, sf):
    impl = read_table(spark, sf, "heritage").where("kind = 'implements'").select(F.col("child_name").alias("c")).distinct()
    seg = F.split("qualified_name", r"\.")
    return view(spark, sf, "fn").select("id", F.when(F.size(seg) >= 2, F.element_at(seg, -2)).alias("c")).join(impl, "c", "left_semi").select("id")


def _resolved(spark, sf):
    calls = read_table(spark, sf, "calls")
    n = F.when(F.coalesce("params", F.lit("")) == "", 0).otherwise(F.size(F.split("params", '"name"')) - 1)
    fn = view(spark, sf, "fn").select("id", "name", "qualified_name", "file_path", n.alias("n_params"))
    return resolve_calls(calls, fn, read_table(spark, sf, "external_symbols"))


_RESOLVE = """with c as (select distinct call_id, called_name, file_path, arg_count, receiver_expr, coalesce(is_pre_resolved, false) pre from calls where called_name is not null),
f as (select id, name, qualified_name, file_path, case when coalesce(params, '') = '' then 0 else len(string_split(params, '"name"')) - 1 end n from fn),
qn as (select q, min(id) id from (select id, qualified_name q from f union all select id, qualified_name from external_symbols) group by 1),
fl as (select name, file_path, min(id) id from f group by 1, 2 having count(*) = 1), ar as (select name, n, min(id) id from f group by 1, 2 having count(*) = 1),
nm as (select name, count(*) k, min(id) id, array_to_string(list_sort(list(distinct id))[1:5], ',') shown from f group by 1), ex as (select name, min(id) id from external_symbols group by 1 having count(*) = 1),
j as (select c.*, qn.id q, fl.id a, ar.id b, nm.k, nm.id u, nm.shown, ex.id x, case when pre and qn.id is not null then 'pre_resolved' when fl.id is not null then 'same_file' when ar.id is not null then 'arg_count' when nm.k = 1 then 'name_unique' when nm.k is null and ex.id is not null then 'external' end r
 from c left join qn on qn.q = called_name left join fl on fl.name = called_name and fl.file_path = c.file_path left join ar on ar.name = called_name and ar.n = arg_count left join nm on nm.name = called_name left join ex on ex.name = called_name)
"""


@query(_RESOLVE + "select call_id, case r when 'pre_resolved' then q when 'same_file' then a when 'arg_count' then b when 'name_unique' then u else x end target_id, r resolved_by, cast(case r when 'pre_resolved' then 0.95 when 'same_file' then 0.85 when 'arg_count' then 0.85 else 0.7 end as double) confidence, coalesce(k, 0) candidates from j where r is not null")
def c01_resolve_calls(spark, sf):
    return _resolved(spark, sf)[0]


@query(_RESOLVE + "select call_id, case when receiver_expr = 'super' or starts_with(receiver_expr, 'super.') then 'super_field_call' when contains(receiver_expr, '(') then 'chained_call' when receiver_expr <> '' and not contains(receiver_expr, '.') then 'lambda_call' when receiver_expr <> '' and ascii(receiver_expr) between 65 and 90 and not regexp_matches(receiver_expr[instr(receiver_expr, '.') + 1:], '[a-z]') and not ends_with(receiver_expr, '.') then 'enum_method' when k <= 9 then 'ambiguous_project_call' else 'untyped_receiver' end hint_type, k candidates, shown from j where r is null and k > 1")
def c10_hints(spark, sf):
    return _resolved(spark, sf)[1]


@query("""with recursive k as (select chain_id scope, 'v' || min(chain_depth) var, min(called_name) t from calls where chain_id > 0 group by 1), m as (select distinct chain_id scope, chain_depth d from calls where chain_id > 0),
n as (select scope, d from m where d = (select min(d) from m x where x.scope = m.scope) union select n.scope, n.d + 1 from n join m on m.scope = n.scope and m.d = n.d + 1 where n.d < (select min(d) from m y where y.scope = n.scope) + 10)
select n.scope, 'v' || n.d var, k.t as \"type\" from n join k on k.scope = n.scope""")
def c27_fixpoint_types(spark, sf):
    """Types along call chains: the first step's name is carried to each following step."""
    c = read_table(spark, sf, "calls").where("chain_id > 0")
    first = c.groupBy(F.col("chain_id").alias("scope")).agg(F.min("chain_depth").alias("d"), F.min("called_name").alias("type"))
    bindings = first.select("scope", F.concat(F.lit("v"), "d").alias("var"), "type")
    steps = c.select(F.col("chain_id").alias("scope"), "chain_depth").distinct()
    copies = steps.select("scope", F.concat(F.lit("v"), "chain_depth").alias("lhs"), F.concat(F.lit("v"), F.col("chain_depth") - 1).alias("rhs"))
    return fixpoint_types(bindings, copies, Scratch(spark))


@query("""with recursive k as (select src file, dst as source from extends_edge), r as (select id file, id origin from cls union select k.file, r.origin from r join k on k.source = r.file)
select file, 'S' symbol, origin from r""")
def j29_export_closure(spark, sf):
    """Exports handed on along links until nothing changes; here classes export along inheritance."""
    return _export_closure(spark, sf, view(spark, sf, "cls"))


def _export_closure(spark, sf, cls):
    exports = cls.select(F.col("id").alias("file"), F.lit("S").alias("symbol"))
    return export_closure(exports, view(spark, sf, "extends_edge").select(F.col("src").alias("file"), F.col("dst").alias("source")), Scratch(spark))


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL
