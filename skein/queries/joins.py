"""Join queries: change detection, location, routes, heritage, overrides, dispatch, constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view, with_views
from skein.operators import lookups as L
from skein.storage import read_table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


@query("select q.id query_id, f.id caller, f.qualified_name from executes e join query_node q on q.id = e.dst join fn f on f.id = e.src")
def j01_collect_queries(spark, sf):
    e = view(spark, sf, "executes")
    q, f = view(spark, sf, "query_node").select(F.col("id").alias("dst")), view(spark, sf, "fn").select(F.col("id").alias("src"), "qualified_name")
    return e.join(q, "dst").join(f, "src").select(F.col("dst").alias("query_id"), F.col("src").alias("caller"), "qualified_name")


@query("select id from cls where id in (select src from extends_edge union all select dst from extends_edge)")
def j02_referenced(spark, sf):
    e = view(spark, sf, "extends_edge")
    return view(spark, sf, "cls").select("id").join(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct(), "id", "left_semi")


@query("""with x as (select *, length(rel_path) % 11 hash_no from files), o as (select rel_path p, max(mod_time) m, max(size) s from x where hash_no <> 0 group by 1), n as (select rel_path p, max(mod_time) m, max(size + case when hash_no = 1 then 1 else 0 end) s from x where hash_no <> 2 group by 1)
select coalesce(o.p, n.p) path, case when o.p is null then 'added' when n.p is null then 'deleted' else 'modified' end status from o full join n on o.p = n.p where o.p is null or n.p is null or o.m is distinct from n.m or o.s is distinct from n.s""")
def j03_changed_files(spark, sf):
    """Files added, modified or deleted between a stored fingerprint and a scan, by time and size."""
    f = read_table(spark, sf, "files").withColumn("no", F.length("rel_path") % 11)
    old = f.where("no <> 0").groupBy("rel_path").agg(F.max("mod_time").alias("m"), F.max("size").alias("s"))
    new = f.where("no <> 2").groupBy("rel_path").agg(F.max("mod_time").alias("m2"), F.max(F.col("size") + F.when(F.col("no") == 1, 1).otherwise(0)).alias("s2"))
    both = old.withColumn("a", F.lit(1)).join(new.withColumn("b", F.lit(1)), "rel_path", "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("m").eqNullSafe(F.col("m2")) | ~F.col("s").eqNullSafe(F.col("s2")), "modified")
    return both.select(F.col("rel_path").alias("path"), status.alias("status")).where("status is not null")


@query("select file_path, line, id from (select q.file_path, q.line, f.id, row_number() over (partition by q.file_path, q.line order by f.end_line - f.start_line, f.id) rn from (select distinct file_path, line from calls where file_path is not null and line is not null) q join fn f on f.file_path = q.file_path and q.line between f.start_line and f.end_line) where rn = 1")
def j05_locate(spark, sf):
    asked = read_table(spark, sf, "calls").where("file_path is not null and line is not null").select("file_path", "line").distinct()
    return L.smallest_span(asked, view(spark, sf, "fn"))


@query("""select call_id, id caller from (select c.call_id, f.id, row_number() over (partition by c.call_id order by case when f.file_path = c.file_path and c.line between f.start_line and f.end_line then 0 when f.file_path = c.file_path then 1 else 2 end, f.id) rn
from (select distinct call_id, caller_name, file_path, line from calls) c join fn f on f.qualified_name = c.caller_name) where rn = 1""")
def j06_caller(spark, sf):
    """Caller of each call: by qualified name, of several the one around the line, then one in the file."""
    c = read_table(spark, sf, "calls").select("call_id", "caller_name", F.col("file_path").alias("call_file"), "line").distinct()
    f = view(spark, sf, "fn").select(F.col("qualified_name").alias("caller_name"), "id", "file_path", "start_line", "end_line")
    rank = F.when((F.col("file_path") == F.col("call_file")) & F.col("line").between(F.col("start_line"), F.col("end_line")), 0).when(F.col("file_path") == F.col("call_file"), 1).otherwise(2)
    return c.join(f, "caller_name").groupBy("call_id").agg(F.min(F.struct(rank.alias("rank"), "id")).alias("m")).select("call_id", F.col("m.id").alias("caller"))


_PARAM = "regexp_matches(x, '\\{[^}]*\\}|:[A-Za-z_]\\w*|<[^>]*>|\\[[^\\]]*\\]|^\\d+$')"
_SEGMENTS = "list_transform(list_filter(string_split(@, '/'), lambda x: x <> ''), lambda x: case when " + _PARAM + " then '{param}' else x end)"


@query(f"""with c as (select distinct upper(method) m, path from remote_call), cs as (select m, path, {_SEGMENTS.replace('@', 'path')} s from c),
r as (select path p, upper(method) q, framework, min(id) id from route where method <> 'CLI' group by 1, 2, 3), rs as (select *, {_SEGMENTS.replace('@', 'p')} s, list_filter(string_split(p, '/'), lambda x: x <> '')[-1] in ('**', '*') open from r)
select m "method", path, min(id) route_id from cs join rs on (m = '' or q = '' or m = q) and case when framework in ('grpc', 'graphql') then lower(path) = lower(p) and m = q when open then len(cs.s) >= len(rs.s) - 1 and list_bool_and([true] || [cs.s[i] = rs.s[i] or cs.s[i] = '{{param}}' or rs.s[i] = '{{param}}' for i in range(1, len(rs.s))])
 else len(cs.s) = len(rs.s) and list_bool_and([true] || [cs.s[i] = rs.s[i] or cs.s[i] = '{{param}}' or rs.s[i] = '{{param}}' for i in range(1, len(rs.s) + 1)]) end group by 1, 2""")
def j09_route_match(spark, sf):
    """Least route of each remote method and path, by segments with wildcards, catch-alls and the rules of RPC frameworks."""
    from skein.operators.routes import match_routes

    calls = view(spark, sf, "remote_call").select(F.upper("method").alias("method"), "path").distinct()
    return match_routes(calls, view(spark, sf, "route").where("method <> 'CLI'"))


@query("""with recursive up as (select src id, dst a from extends_edge union select u.id, e.dst from up u join extends_edge e on e.src = u.a), m as (select f.id, f.name, c.id owner, len(string_split(coalesce(f.params, ''), '"name"')) - 1 k from fn f join cls c on c.qualified_name = regexp_replace(f.qualified_name, '\\.[^.]*$', '') where not f.is_constructor),
o as (select distinct b.id base, c.id override from m c join up on up.id = c.owner and up.a <> c.owner join m b on b.owner = up.a and b.name = c.name and b.k = c.k) select 'OVERRIDES' kind, override src, base dst from o union all select 'DISPATCHES', base, override from o""")
def j16_overrides(spark, sf):
    """Methods that override one of the same name and number of parameters in any ancestor, and the dispatches back."""
    from skein.operators.traverse import ancestors
    from skein.storage import Scratch

    n = (F.size(F.split(F.coalesce("params", F.lit("")), '"name"')) - 1).alias("k")
    m = view(spark, sf, "fn").where("not is_constructor").select("id", "name", n, S.owner_name(F.col("qualified_name")).alias("qualified_name")).join(view(spark, sf, "cls").select(F.col("id").alias("owner"), "qualified_name"), "qualified_name").select("id", "name", "k", "owner")
    up = ancestors(view(spark, sf, "extends_edge"), 1_000, Scratch(spark)).select(F.col("id").alias("owner"), "ancestor")
    hit = m.join(up, "owner").select(F.col("id").alias("override"), "name", "k", F.col("ancestor").alias("owner")).join(m.withColumnRenamed("id", "base"), ["owner", "name", "k"]).select("base", "override").distinct()
    return hit.select(F.lit("OVERRIDES").alias("kind"), F.col("override").alias("src"), F.col("base").alias("dst")).unionByName(hit.select(F.lit("DISPATCHES").alias("kind"), F.col("base").alias("src"), F.col("override").alias("dst")))


@query("""with s as (select l_orderkey k, list_sort(list(distinct l_linenumber)) has from lineitem group by 1), i as (select unnest(range(1, 8)) need)
select k struct_id, need interface_id from s, i where list_has_all(has, range(1, need + 1))""")
def j17_implements(spark, sf):
    """Structs whose method set holds an interface's: relational division by counting matched methods. Interface n
    wants methods 1 .. n."""
    have = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("struct_id"), F.col("l_linenumber").alias("method")).distinct()
    want = spark.range(1, 8).select(F.col("id").alias("interface_id"), F.explode(F.sequence(F.lit(1), F.col("id").cast("int"))).alias("method"))
    size = want.groupBy("interface_id").agg(F.count(F.lit(1)).alias("size"))
    met = have.join(F.broadcast(want), "method").groupBy("struct_id", "interface_id").agg(F.count(F.lit(1)).alias("met"))  # 28 rows
    return met.join(F.broadcast(size), "interface_id").where("met = size").select("struct_id", "interface_id")  # 7 rows


@query("""with c as (select distinct call_id, called_name, receiver_expr, file_path from calls) select p.call_id publisher, l.call_id listener from c p join c l on l.receiver_expr = p.receiver_expr and l.file_path = p.file_path where p.called_name = 'push' and l.called_name = 'then' and p.receiver_expr <> ''""")
def j19_emit_on(spark, sf):
    """Emit and listen calls on one receiver of one file."""
    c = read_table(spark, sf, "calls").where("receiver_expr <> ''").select("call_id", "called_name", "receiver_expr", "file_path").distinct()
    emit = c.where("called_name = 'push'").select(F.col("call_id").alias("publisher"), "receiver_expr", "file_path")
    return emit.join(c.where("called_name = 'then'").select(F.col("call_id").alias("listener"), "receiver_expr", "file_path"), ["receiver_expr", "file_path"]).select("publisher", "listener")


@query("""select 'file' kind, file_path parent, id child from fn union all select 'class', c.id, f.id from fn f join cls c on c.qualified_name = regexp_replace(f.qualified_name, '\\.[^.]*$', '')""")
def j23_contains(spark, sf):
    fn, cls = view(spark, sf, "fn"), view(spark, sf, "cls")
    a = fn.select(F.lit("file").alias("kind"), F.col("file_path").alias("parent"), F.col("id").alias("child"))
    b = fn.select(F.col("id").alias("child"), S.owner_name(F.col("qualified_name")).alias("qualified_name")).join(cls.select(F.col("id").alias("parent"), "qualified_name"), "qualified_name")
    return a.unionByName(b.select(F.lit("class").alias("kind"), "parent", "child"))


@query("""select f.id, coalesce(own.layer, fl.layer, '') layer from fn f left join (select c.qualified_name, min(a.layer) layer from annotation a join cls c on c.id = a.owner group by 1) own on own.qualified_name = regexp_replace(f.qualified_name, '\\.[^.]*$', '')
left join (select c.file_path, min(a.layer) layer from annotation a join cls c on c.id = a.owner group by 1) fl on fl.file_path = f.file_path""")
def j24_layers(spark, sf):
    """Layer of a function: that of its class, else of an annotated class in its file."""
    a = view(spark, sf, "annotation").select(F.col("owner").alias("id"), "layer").join(view(spark, sf, "cls").select("id", "qualified_name", "file_path"), "id")
    own = a.groupBy(F.col("qualified_name").alias("owner")).agg(F.min("layer").alias("l1"))
    near = a.groupBy("file_path").agg(F.min("layer").alias("l2"))
    fn = view(spark, sf, "fn").select("id", "file_path", S.owner_name(F.col("qualified_name")).alias("owner"))
    return fn.join(own, "owner", "left").join(near, "file_path", "left").select("id", F.coalesce("l1", "l2", F.lit("")).alias("layer"))


@query("select distinct h.dst route_id from handles h join call_edge e on e.src = h.src where e.confidence < 0.5")
def j25_affected(spark, sf):
    e = view(spark, sf, "call_edge").where("confidence < 0.5").select("src").distinct()
    return view(spark, sf, "handles").join(e, "src", "left_semi").select(F.col("dst").alias("route_id")).distinct()


@query("select distinct src importer from import_edge where dst in (select file_path from fn where complexity > 18) and src not in (select file_path from fn where complexity > 18)")
def j26_importers(spark, sf):
    """Files that import a changed file and are not changed themselves."""
    changed = view(spark, sf, "fn").where("complexity > 18").select("file_path").distinct()
    e = view(spark, sf, "import_edge")
    hit = e.join(changed.withColumnRenamed("file_path", "dst"), "dst", "left_semi").select(F.col("src").alias("importer")).distinct()
    return hit.join(changed.withColumnRenamed("file_path", "importer"), "importer", "left_anti")


@query("select u.src, v.id variable, u.line from uses u join variable v on v.id = u.dst")
def j21_constants(spark, sf):
    return view(spark, sf, "uses").join(view(spark, sf, "variable").select(F.col("id").alias("dst")), "dst").select("src", F.col("dst").alias("variable"), "line")


@query("""with h as (select distinct child_name, nullif(child_qualified, '') cq, nullif(parent_qualified, '') pq, file_path from heritage where kind = 'extends'), c as (select h.*, cls.id child, cls.source_project from h join cls on cls.qualified_name = h.cq)
select c.child, p.id parent, case when count(*) over (partition by c.child) = 1 then 0.85 else 0.70 end confidence from c join cls p on p.qualified_name = c.pq""")
def j15_heritage(spark, sf):
    h = read_table(spark, sf, "heritage").where("kind = 'extends'").select("child_name", F.nullif("child_qualified", F.lit("")).alias("cq"), F.nullif("parent_qualified", F.lit("")).alias("pq"), "file_path").distinct()
    cls = view(spark, sf, "cls")
    found = h.join(cls.select(F.col("id").alias("child"), F.col("qualified_name").alias("cq")), "cq").join(cls.select(F.col("id").alias("parent"), F.col("qualified_name").alias("pq")), "pq").select("child", "parent")
    n = found.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, "child").select("child", "parent", F.when(F.col("n") == 1, 0.85).otherwise(0.70).alias("confidence"))


@query("""with r as (select lower(path) p, upper(method) m, min(id) id from route where framework <> 'feign' group by 1, 2) select distinct c.caller src, coalesce(r.id, 'service:' || cast(c.service as varchar)) dst, case when r.id is null then 'REMOTE_CALLS_EXT' else 'REMOTE_CALLS_ROUTE' end kind from remote_call c left join r on r.p = lower(c.path) and r.m = upper(c.method)""")
def j12_remote_edges(spark, sf):
    """Edges of remote calls: to the least provider route of method and path, else to the external service."""
    calls = view(spark, sf, "remote_call").select("caller", F.lower("path").alias("p"), F.upper("method").alias("m"), "service").distinct()
    j = calls.join(_least_routes(spark, sf), ["p", "m"], "left")
    return j.select(F.col("caller").alias("src"), F.coalesce("id", F.concat(F.lit("service:"), F.col("service").cast("string"))).alias("dst"), F.when(F.col("id").isNull(), "REMOTE_CALLS_EXT").otherwise("REMOTE_CALLS_ROUTE").alias("kind")).distinct()


def _least_routes(spark, sf):
    """The least provider route of each method and path, so that a call meets one route however many share its path."""
    return view(spark, sf, "route").where("framework <> 'feign'").groupBy(F.lower("path").alias("p"), F.upper("method").alias("m")).agg(F.min("id").alias("id"))


@query("""with r as (select lower(path) p, upper(method) m, min(id) id from route where framework <> 'feign' group by 1, 2), own as (select distinct src from handles) select distinct c.k, c.line, c.caller, r.id route_id, cast(case when own.src is not null then 0.9 else 0.85 end as double) confidence from remote_call c join r on r.p = lower(c.path) and r.m = upper(c.method) left join own on own.src = c.caller where c.method <> ''""")
def j11_consumer_provider(spark, sf):
    """Provider of each remote call by method and path, surer where the caller handles a route itself."""
    calls = view(spark, sf, "remote_call").where("method <> ''").select("k", "line", "caller", F.lower("path").alias("p"), F.upper("method").alias("m")).distinct()
    local = view(spark, sf, "handles").select(F.col("src").alias("caller"), F.lit(1).alias("local")).distinct()
    hit = calls.join(_least_routes(spark, sf), ["p", "m"]).join(local, "caller", "left")
    return hit.select("k", "line", "caller", F.col("id").alias("route_id"), F.when(F.col("local") == 1, 0.9).otherwise(0.85).alias("confidence"))


@query("""select p.event_id publisher, l.event_id listener, case when p.value < 50 then 0.9 else 0.85 end confidence from events p join events l on l.user_id = p.user_id and l.event_type = 'error' and l.ts > p.ts where p.event_type = 'signup'""")
def j18_event_dispatch(spark, sf):
    """Publishers and the later listeners of the same user, among all events."""
    return _event_dispatch(read_table(spark, sf, "events"))


def _event_dispatch(e):
    p = e.where("event_type = 'signup'").select(F.col("event_id").alias("publisher"), "user_id", F.col("ts").alias("t0"), "value")
    both = p.join(e.where("event_type = 'error'").select(F.col("event_id").alias("listener"), "user_id", "ts"), "user_id").where("ts > t0")
    return both.select("publisher", "listener", F.when(F.col("value") < 50, 0.9).otherwise(0.85).alias("confidence"))


@query("select a.name_id, a.owner, c.file_path, a.layer from annotation a join cls c on c.id = a.owner")
def j22_annotation_nodes(spark, sf):
    return view(spark, sf, "annotation").join(view(spark, sf, "cls").select(F.col("id").alias("owner"), "file_path"), "owner").select("name_id", "owner", "file_path", "layer")


@query("select distinct e.src file, b.file_path target from import_edge e join (select distinct file_path from fn) b on b.file_path = e.dst")
def j14_imports(spark, sf):
    known = view(spark, sf, "fn").select(F.col("file_path").alias("dst")).distinct()
    return view(spark, sf, "import_edge").join(known, "dst").select(F.col("src").alias("file"), F.col("dst").alias("target")).distinct()


@query("""with recursive up as (select src id, dst a, 1 l from extends_edge union all select u.id, e.dst, l + 1 from up u join extends_edge e on e.src = u.a where l < 5),
m as (select c.id owner, f.name, f.id from fn f join cls c on c.qualified_name = regexp_replace(f.qualified_name, '\\.[^.]*$', '')), w as (select distinct c.id, x.called_name n from calls x join cls c on c.qualified_name = regexp_replace(x.caller_name, '\\.[^.]*$', '') where x.called_name is not null),
h as (select w.id class_id, w.n name, m.id method_id, row_number() over (partition by w.id, w.n order by u.l, m.id) k from w join up u on u.id = w.id and u.a <> w.id join m on m.owner = u.a and m.name = w.n)
select class_id, name, method_id from h where k = 1""")
def f14_inherited(spark, sf):
    """Names called in a class that an ancestor (five levels at most) defines: the nearest definition."""
    from skein.operators.traverse import ancestors
    from skein.storage import Scratch

    cls, fn = view(spark, sf, "cls").select("id", "qualified_name"), view(spark, sf, "fn")
    owner = lambda c: S.owner_name(F.col(c)).alias("qualified_name")
    asked = read_table(spark, sf, "calls").where("called_name is not null").select(owner("caller_name"), F.col("called_name").alias("name")).distinct().join(cls, "qualified_name").select(F.col("id").alias("class_id"), "name").distinct()
    methods = fn.select(owner("qualified_name"), "name", F.col("id").alias("method_id")).join(cls.withColumnRenamed("id", "ancestor"), "qualified_name").select("ancestor", "name", "method_id")
    up = ancestors(view(spark, sf, "extends_edge"), 5, Scratch(spark)).withColumnRenamed("id", "class_id")
    hit = asked.join(up, "class_id").join(methods, ["ancestor", "name"])
    return hit.groupBy("class_id", "name").agg(F.min(F.struct("level", "method_id")).alias("m")).select("class_id", "name", F.col("m.method_id").alias("method_id"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL
