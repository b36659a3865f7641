"""More lookups, predicates and joins over the graph, each with SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view, with_views
from skein.operators import lookups as L
from skein.operators import overloads
from skein.operators.prefix_sum import number_rows
from skein.operators.traverse import ancestors
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


_PARAMS = "array<struct<name:string,type:string,has_default:boolean>>"
_NAME = "regexp_extract({}, '[^.]*$')"


def _arity(fn):
    """Functions with their parsed parameters; a missing list has none."""
    parsed = F.coalesce(F.from_json(F.nullif("params", F.lit("")), _PARAMS), F.array().cast(_PARAMS))
    return fn.withColumn("parsed", parsed)


# ---- Point and set lookups


@query("select e.edge_id, e.src, e.dst, e.confidence, e.line from call_edge e where e.src in (select id from fn where complexity > 18)")
def f10_edges_of_nodes(spark, sf):
    """Outgoing calls of a node set, with confidence and line."""
    ids = view(spark, sf, "fn").where("complexity > 18").select(F.col("id").alias("src"))
    return view(spark, sf, "call_edge").join(ids, "src", "left_semi").select("edge_id", "src", "dst", "confidence", "line")


# Tables of a relation by the kind of its source, where it has several.
RELATION_TABLES = {("CONTAINS", "File"): "File_CONTAINS", ("CONTAINS", "Class"): "Class_CONTAINS", ("HAS_ANNOTATION", "Function"): "Function_HAS_ANNOTATION", ("HAS_ANNOTATION", "Class"): "Class_HAS_ANNOTATION"}


@query("select kind, source_kind, case when kind in ('CONTAINS', 'HAS_ANNOTATION') and source_kind in ('File', 'Class', 'Function') then source_kind || '_' || kind else kind end table_name, count(*) n from (select distinct edge_id, kind, source_kind from edges where kind is not null and source_kind is not null) group by 1, 2, 3")
def f11_relation_tables(spark, sf):
    """Physical table of each relation and source kind, with its rows."""
    e = read_table(spark, sf, "edges").where("kind is not null and source_kind is not null").select("edge_id", "kind", "source_kind").distinct()
    names = F.create_map(*[x for (k, s), t in RELATION_TABLES.items() for x in (F.lit(f"{k}/{s}"), F.lit(t))])
    return e.groupBy("kind", "source_kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "source_kind", F.coalesce(names[F.concat_ws("/", "kind", "source_kind")], F.col("kind")).alias("table_name"), "n")


@query("select id, qualified_name, (select count(*) from (select name from fn union all select name from cls) where name = '__init__' or name = 'close') total from (select id, name, qualified_name, file_path, start_line from fn union all select id, name, qualified_name, file_path, start_line from cls) where name = '__init__' or name = 'close' order by file_path, start_line, id limit 20")
def f12_query_symbol(spark, sf):
    """First page of the nodes of a name, in the total order of nodes, with the number of all."""
    part = lambda v: view(spark, sf, v).select("id", "name", "qualified_name", "file_path", "start_line")
    every = part("fn").unionByName(part("cls"))
    return L.page(L.by_name(every, "__init__").unionByName(L.by_name(every, "close")), L.ORDER, 0, 20).select("id", "qualified_name", "total")


@query("select distinct c.id, c.qualified_name, a.category from annotation a join cls c on c.id = a.owner where a.category in ('route', 'orm')")
def f17_by_category(spark, sf):
    a = view(spark, sf, "annotation").where(F.col("category").isin("route", "orm")).select(F.col("owner").alias("id"), "category").distinct()
    return view(spark, sf, "cls").select("id", "qualified_name").join(a, "id")


@query("select id, qualified_name from cls where id in (select owner from annotation where category = 'component') order by id limit 50")
def f18_annotated_owners(spark, sf):
    """First fifty owners of a set of annotations, each once (a page by design)."""
    a = view(spark, sf, "annotation").where("category = 'component'").select(F.col("owner").alias("id")).distinct()
    return view(spark, sf, "cls").join(a, "id", "left_semi").select("id", "qualified_name").orderBy("id").limit(50)


@query("select id, qualified_name from variable where contains(qualified_name, 'U')")
def f24_variables(spark, sf):
    return L.by_property(view(spark, sf, "variable"), "qualified_name", "U", "contains").select("id", "qualified_name")


@query("select id, case when method in ('CLI', 'TOOL') then 'command' else 'http' end route_type from route")
def f28_route_types(spark, sf):
    return view(spark, sf, "route").select("id", F.when(F.col("method").isin("CLI", "TOOL"), "command").otherwise("http").alias("route_type"))


# ---- Predicates over candidates


@query("""select c.call_id, f.id from (select distinct call_id, called_name, string_split(caller_name, '.')[-2] r from calls where receiver_expr in ('self', 'this') and contains(caller_name, '.')) c join fn f on f.name = c.called_name and (contains(f.qualified_name, '.' || r || '.') or starts_with(f.qualified_name, r || '.'))""")
def f31_owner_class(spark, sf):
    """Candidates of calls on self or this that lie in the caller's class."""
    c = read_table(spark, sf, "calls").where("receiver_expr in ('self', 'this') and contains(caller_name, '.')").select("call_id", F.col("called_name").alias("name"), F.element_at(F.split("caller_name", r"\."), -2).alias("r")).distinct()
    hit = c.join(view(spark, sf, "fn").select("id", "name", "qualified_name"), "name")
    return hit.where(S.in_owner(F.col("qualified_name"), F.col("r"))).select("call_id", "id")


@query("""with f as (select id, name, cast(coalesce(nullif(params, ''), '[]') as json) p from fn), g as (select id, name, json_array_length(p)::int n, coalesce(json_extract_string(p, '$[' || greatest(json_array_length(p)::int - 1, 0) || '].type'), '') last_type, len(list_filter(cast(json_extract(p, '$[*].has_default') as boolean[]), lambda x: x)) optional from f)
select c.call_id, g.id from (select distinct call_id, called_name, arg_count from calls where arg_count is not null) c join g on g.name = c.called_name and case when n > 0 and ends_with(last_type, '...') then arg_count >= n - 1 else arg_count between n - coalesce(optional, 0) and n end""")
def f33_argument_count(spark, sf):
    """Candidates of a call's name that take its number of arguments."""
    c = read_table(spark, sf, "calls").where("arg_count is not null").select("call_id", F.col("called_name").alias("name"), "arg_count").distinct()
    f = _arity(view(spark, sf, "fn")).select("id", "name", "parsed")
    return c.join(f, "name").where(S.accepts_arguments(F.col("parsed"), F.col("arg_count"))).select("call_id", "id")


def f34_argument_types(spark, sf):
    """Overloads that a call's argument types leave; tests compare with a plain search."""
    c = read_table(spark, sf, "calls").where("called_name is not null and arg_types is not null").select("call_id", F.col("called_name").alias("name"), F.col("arg_types").alias("arguments")).groupBy("call_id", "name").agg(F.min("arguments").alias("arguments"))
    f = _arity(view(spark, sf, "fn")).select("id", "name", F.transform("parsed", lambda p: F.coalesce(p["type"], F.lit(""))).alias("params"), F.array().cast("array<string>").alias("generics"))
    links = view(spark, sf, "cls").select(F.col("id").alias("src"), F.col("name").alias("child")).join(view(spark, sf, "extends_edge"), "src").join(view(spark, sf, "cls").select(F.col("id").alias("dst"), F.col("name").alias("parent")), "dst").select("child", "parent").distinct()
    # Read three times, so written once.
    candidates = Scratch(spark).save(c.join(f, "name").select("call_id", "id", "params", "arguments", "generics"))
    types = overloads.compatible(spark, overloads.type_closure(spark, links, 32, *overloads.asked_types(spark, candidates)))
    return overloads.by_argument_types(candidates, types)


Q["f34_argument_types"] = f34_argument_types


@query("select f.id, c.id module from fn f join cls c on f.qualified_name = c.qualified_name or starts_with(f.qualified_name, c.qualified_name || '.')")
def f35_import_match(spark, sf):
    """Functions that an import of a class makes visible: the names' dotted prefixes are joined on equality."""
    parts = F.split("qualified_name", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    f = view(spark, sf, "fn").select("id", F.explode(heads).alias("qualified_name"))
    return f.join(view(spark, sf, "cls").select(F.col("id").alias("module"), "qualified_name"), "qualified_name").select("id", "module")


@query("select id, kind = 'Class' or coalesce(class_type, '') in ('class', 'interface', 'struct', 'enum') class_like from (select id, 'Function' kind, class_type from fn union all select id, 'Class', class_type from cls)")
def f36_class_like(spark, sf):
    part = lambda v, k: view(spark, sf, v).select("id", F.lit(k).alias("kind"), "class_type")
    return part("fn", "Function").unionByName(part("cls", "Class")).select("id", ((F.col("kind") == "Class") | F.coalesce("class_type", F.lit("")).isin("class", "interface", "struct", "enum")).alias("class_like"))


# ---- Cross index: symbols and routes of other projects

_DEPS = "deps as (select distinct source_project p from fingerprint_files where branch = 'main')"


def _dependencies(spark, sf):
    return read_table(spark, sf, "fingerprint_files").where("branch = 'main'").select(F.col("source_project").alias("p")).distinct()


@query(f"with {_DEPS}, w as (select distinct called_name t from calls where called_name is not null) select t as \"text\", id, source_project from w join fn on fn.name = {_NAME.format('t')} or fn.qualified_name = t where source_project in (select p from deps) and (qualified_name = t or name = t or ends_with(qualified_name, '.' || t))")
def f38_cross_symbols(spark, sf):
    """Symbols of dependency projects by qualified name, name or end of the qualified name. The last segment of each is
    the short name, so the join is on equality."""
    w = read_table(spark, sf, "calls").where("called_name is not null").select(F.col("called_name").alias("text")).distinct().withColumn("name", F.substring_index("text", ".", -1))
    f = view(spark, sf, "fn").join(_dependencies(spark, sf).withColumnRenamed("p", "source_project"), "source_project", "left_semi").select("id", "name", "qualified_name", "source_project")
    hit = w.join(f, "name").where((F.col("qualified_name") == F.col("text")) | (F.col("name") == F.col("text")) | F.expr("endswith(qualified_name, '.' || text)"))
    whole = w.select("text").join(f.withColumnRenamed("qualified_name", "text"), "text").select("text", "id", "source_project")
    return hit.select("text", "id", "source_project").unionByName(whole).distinct()


@query("""with r as (select r.framework, lower(r.path) p, f.source_project, min(r.id) id from route r join handles h on h.dst = r.id join fn f on f.id = h.src where r.framework <> 'feign' group by 1, 2, 3)
select s.framework, s.path service, r.source_project, r.id from (select distinct framework, path from route) s join r on r.framework = s.framework and r.p = lower(s.path)""")
def f39_routes_by_service(spark, sf):
    """Provider routes of a framework whose path is the service's, the first per project."""
    h = view(spark, sf, "handles").select(F.col("dst").alias("id"), F.col("src").alias("fn")).join(view(spark, sf, "fn").select(F.col("id").alias("fn"), "source_project"), "fn")
    r = view(spark, sf, "route").where("framework <> 'feign'").join(h, "id").groupBy("framework", F.lower("path").alias("p"), "source_project").agg(F.min("id").alias("id"))
    asked = view(spark, sf, "route").select("framework", F.col("path").alias("service"), F.lower("path").alias("p")).distinct()
    return asked.join(r, ["framework", "p"]).select("framework", "service", "source_project", "id")


@query(f"with {_DEPS} select id, source_project from fn where source_project in (select p from deps) union all select id, source_project from cls where source_project in (select p from deps)")
def f40_dependency_symbols(spark, sf):
    part = lambda v: view(spark, sf, v).select("id", "source_project")
    return part("fn").unionByName(part("cls")).join(_dependencies(spark, sf).withColumnRenamed("p", "source_project"), "source_project", "left_semi").select("id", "source_project")


# ---- Joins


@query("""with h as (select distinct called_name n, file_path f from calls where called_name is not null), k as (select n, f, id, case when qualified_name = n then 0 when file_path = f and name = n then 1 when ends_with(qualified_name, '.' || n) then 2 when name = regexp_extract(n, '[^.]*$') then 3 end r
from h join fn on fn.name = regexp_extract(n, '[^.]*$')) select n handler_name, f file_path, id from (select *, row_number() over (partition by n, f order by r, id) o from k where r is not null) where o = 1""")
def j08_handlers(spark, sf):
    """Function of each handler name: by qualified name, by name in the same file, by the end of the qualified name, by
    name anywhere; the best by rank, then id."""
    h = read_table(spark, sf, "calls").where("called_name is not null").select("called_name", F.col("file_path").alias("f")).distinct().withColumn("name", F.substring_index("called_name", ".", -1))
    fn = view(spark, sf, "fn").select("id", "name", "qualified_name", "file_path")
    rank = F.when(F.col("qualified_name") == F.col("called_name"), 0).when((F.col("file_path") == F.col("f")) & (F.col("name") == F.col("called_name")), 1).when(F.expr("endswith(qualified_name, '.' || called_name)"), 2).otherwise(3)
    best = h.join(fn, "name").groupBy("called_name", "f").agg(F.min(F.struct(rank.alias("r"), "id")).alias("m"))
    return best.select(F.col("called_name").alias("handler_name"), F.col("f").alias("file_path"), F.col("m.id").alias("id"))


@query("""select distinct r.method, r.path, p.id from (select distinct upper(method) method, lower(path) path from remote_call where method <> '') r join route p on p.framework <> 'feign' and upper(p.method) = r.method and lower(p.path) = r.path join handles h on h.dst = p.id
join fn f on f.id = h.src where f.source_project in (select distinct source_project from fingerprint_files where branch = 'main')""")
def j10_cross_routes(spark, sf):
    """Provider routes of dependency projects with a remote call's method and path, case aside."""
    calls = view(spark, sf, "remote_call").where("method <> ''").select(F.upper("method").alias("method"), F.lower("path").alias("path")).distinct()
    own = view(spark, sf, "fn").join(_dependencies(spark, sf).withColumnRenamed("p", "source_project"), "source_project", "left_semi").select(F.col("id").alias("src"))
    ids = view(spark, sf, "handles").join(own, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    routes = view(spark, sf, "route").where("framework <> 'feign'").select("id", F.upper("method").alias("method"), F.lower("path").alias("path")).join(ids, "id", "left_semi")
    return calls.join(routes, ["method", "path"]).select("method", "path", "id").distinct()


@query("""with i as (select distinct child_name, parent_name from heritage where kind = 'implements'), m as (select id, name, case when contains(qualified_name, '.') then string_split(qualified_name, '.')[-2] end owner from fn), f as (select distinct h.src from handles h join route r on r.id = h.dst where r.framework = 'feign'),
s as (select distinct c.name from cls c join annotation a on a.owner = c.id where a.name = 'RestController') select distinct a.id src, b.id dst, cast(1.0 as double) confidence from m a join f on f.src = a.id join i on i.parent_name = a.owner join s on s.name = i.child_name join m b on b.owner = i.child_name and b.name = a.name""")
def j20_feign_implementations(spark, sf):
    """Calls from a client interface's method to the same method of implementing controllers."""
    seg = F.split("qualified_name", r"\.")
    m = view(spark, sf, "fn").select("id", "name", F.when(F.size(seg) >= 2, F.element_at(seg, -2)).alias("owner"))
    feign = view(spark, sf, "handles").join(view(spark, sf, "route").where("framework = 'feign'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    i = read_table(spark, sf, "heritage").where("kind = 'implements'").select("child_name", F.col("parent_name").alias("owner")).distinct()
    rest = view(spark, sf, "cls").join(view(spark, sf, "annotation").where("name = 'RestController'").select(F.col("owner").alias("id")), "id", "left_semi").select(F.col("name").alias("child_name")).distinct()
    calls = m.join(feign, "id", "left_semi").join(i, "owner").join(rest, "child_name", "left_semi").select(F.col("id").alias("src"), "name", F.col("child_name").alias("owner"))
    return calls.join(m.select(F.col("id").alias("dst"), "name", "owner"), ["owner", "name"]).select("src", "dst", F.lit(1.0).alias("confidence")).distinct()


@query("""with f as (select id, source_project, qualified_name, cast(coalesce(nullif(params, ''), '[]') as json) p, count(*) over (partition by source_project, qualified_name) k from fn where source_project in (select distinct source_project from fingerprint_files where branch = 'main'))
select id, case when k > 1 then qualified_name || '(' || coalesce(array_to_string(list_transform(cast(json_extract_string(p, '$[*].type') as varchar[]), lambda x: coalesce(x, '')), ','), '') || ')' else qualified_name end symbol from f""")
def j27_injected_symbols(spark, sf):
    """Symbols of dependency projects as candidates; overloads carry their parameter types."""
    f = _arity(view(spark, sf, "fn").join(_dependencies(spark, sf).withColumnRenamed("p", "source_project"), "source_project", "left_semi"))
    k = f.groupBy("source_project", "qualified_name").agg(F.count(F.lit(1)).alias("k"))
    types = F.array_join(F.transform("parsed", lambda p: F.coalesce(p["type"], F.lit(""))), ",")
    return f.join(k, ["source_project", "qualified_name"]).select("id", F.when(F.col("k") > 1, F.concat("qualified_name", F.lit("("), types, F.lit(")"))).otherwise(F.col("qualified_name")).alias("symbol"))


@query("""with t as (select s_suppkey k, 'svc.${nation.' || cast(s_nationkey + s_suppkey % 2 * 20 as varchar) || '}' s, cast(s_nationkey + s_suppkey % 2 * 20 as int) key from supplier)
select k, case when n_name is not null then 'svc.' || n_name else s end service, n_name is null unresolved from t left join nation on n_nationkey = key""")
def j28_placeholders(spark, sf):
    """Service names with ${key} filled in from a properties table; keys it lacks stay and are reported."""
    key = (F.col("s_nationkey") + F.col("s_suppkey") % 2 * 20).cast("int")
    t = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("svc.${nation."), key.cast("string"), F.lit("}")).alias("s"))
    props = read_table(spark, sf, "nation").select(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("v"))
    return fill_placeholders(t, "s", props).select("k", F.col("s").alias("service"), "unresolved")


def fill_placeholders(df, column, properties):
    """`column` with its first ${key} replaced by the value of properties (key, v); unresolved tells that the key is unknown."""
    found = df.withColumn("key", F.regexp_extract(column, r"\$\{([^}]*)\}", 1)).join(properties, "key", "left")
    filled = F.when(F.col("v").isNotNull(), F.expr(f"replace({column}, '${{' || key || '}}', v)")).otherwise(F.col(column))
    return found.withColumn("unresolved", (F.col("key") != "") & F.col("v").isNull()).withColumn(column, filled).drop("key", "v")


# ---- Traversal


@query("""with recursive own as (select id, json_extract_string(x, '$.name') n from (select id, unnest(cast(fields as json[])) x from cls where fields is not null)), up as (select src id, dst a, 1 l from extends_edge union all select u.id, e.dst, l + 1 from up u join extends_edge e on e.src = u.a where l < 5),
every as (select id, n, id a, 0 l from own union all select up.id, own.n, up.a, l from up join own on own.id = up.a where up.id <> up.a)
select id class_id, n field, a declared_in from (select *, row_number() over (partition by id, n order by l, a) k from every) where k = 1""")
def t08_field_in_hierarchy(spark, sf):
    """Every field that a class has or inherits (five levels at most), with the nearest class that declares it."""
    cls = view(spark, sf, "cls")
    own = L.fields_of(cls).select(F.col("class_id").alias("a"), "field").distinct()
    up = ancestors(view(spark, sf, "extends_edge"), 5, Scratch(spark)).select(F.col("id").alias("class_id"), F.col("ancestor").alias("a"), F.col("level").alias("l"))
    every = own.select(F.col("a").alias("class_id"), "a", "field", F.lit(0).alias("l")).unionByName(up.join(own, "a").select("class_id", "a", "field", "l"))
    return every.groupBy("class_id", "field").agg(F.min(F.struct("l", "a")).alias("m")).select("class_id", "field", F.col("m.a").alias("declared_in"))


@query("""with recursive up as (select src id, dst a, 1 l from extends_edge union all select u.id, e.dst, l + 1 from up u join extends_edge e on e.src = u.a where l < 40),
ring as (select distinct id from up where id = a), ok as (select id from cls where id not in (select id from ring) and id not in (select id from up where a in (select id from ring)))
select c.name as "class", ok.id, ok.id || coalesce((select string_agg('>' || a, '' order by l) from up where up.id = ok.id), '') mro from ok join cls c on c.id = ok.id where ok.id in (select src from extends_edge union select dst from extends_edge)""")
def t09_mro(spark, sf):
    """Linearisation of every class of the single-parent links that lies neither on nor below a cycle. A hierarchy with one
    parent each is its chain of ancestors; `linearise` merges several parents."""
    ext = view(spark, sf, "extends_edge")
    up = ancestors(ext, 40, Scratch(spark))
    from skein.operators.traverse import reachable_sizes

    levels = reachable_sizes(ext.select(F.col("dst").alias("src"), F.col("src").alias("dst")), Scratch(spark)).where("level is not null").select("id")
    chain = up.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "ancestor"))), lambda x: x["ancestor"]).alias("up"))
    full = levels.join(chain, "id", "left").select("id", F.array_join(F.concat(F.array("id"), F.coalesce("up", F.array().cast("array<string>"))), ">").alias("mro"))
    return full.join(view(spark, sf, "cls").select("id", F.col("name").alias("class")), "id").select("class", "id", "mro")


# ---- Statistics, sorts, sets


@query("select kind, count(*) n from (select distinct edge_id, kind from edges) where kind is not null group by 1")
def a08_relation_counts(spark, sf):
    return read_table(spark, sf, "edges").where("kind is not null").select("edge_id", "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select distinct call_id, language, called_name, receiver_expr, arg_count from calls where language in ('typescript', 'javascript')) select language, case when coalesce(receiver_expr, '') = '' then 'plain' when receiver_expr in ('this', 'super') then 'own' when contains(receiver_expr, '(') then 'chained' when contains(receiver_expr, '.') then 'path' else 'variable' end site,
count(*) n_calls, count(distinct called_name) n_names, sum(coalesce(arg_count, 0))::bigint n_arguments from c group by 1, 2""")
def a16_script_calls(spark, sf):
    """Call sites of TypeScript and JavaScript by the form of their receiver."""
    r = F.coalesce("receiver_expr", F.lit(""))
    site = F.when(r == "", "plain").when(r.isin("this", "super"), "own").when(r.contains("("), "chained").when(r.contains("."), "path").otherwise("variable")
    c = read_table(spark, sf, "calls").where("language in ('typescript', 'javascript')").select("call_id", "language", "called_name", "receiver_expr", "arg_count").distinct()
    return c.groupBy("language", site.alias("site")).agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("called_name").alias("n_names"), F.sum(F.coalesce("arg_count", F.lit(0))).cast("long").alias("n_arguments"))


@query("""with p as (select user_id phase, min(ts) a, max(ts) z from events where event_type = 'signup' group by 1) select phase, count(*) n, round(max(value), 3) peak, round(avg(value), 3) mean from p join events e on e.ts between a and z and e.user_id = phase group by 1""")
def a17_phase_profile(spark, sf):
    """Peak and mean of the samples that fall into each phase's interval; phases and samples share the process, so the
    interval join is one on equality with a bound."""
    e = read_table(spark, sf, "events")
    p = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return e.join(p, "user_id").where("ts between a and z").groupBy(F.col("user_id").alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 3).alias("peak"), F.round(F.avg("value"), 3).alias("mean"))


@query("select row_number() over (order by entry_type, qualified_name, id) - 1 \"position\", id, entry_type from fn where entry_type <> ''")
def l04_entry_listing(spark, sf):
    """Entry points in listing order: type, qualified name, id; numbered without gathering them."""
    e = view(spark, sf, "fn").where("entry_type <> ''").select("id", "entry_type", "qualified_name")
    return number_rows(e, ["entry_type", "qualified_name", "id"], "position", Scratch(spark)).select("position", "id", "entry_type")


@query("select call_id, array_to_string(list_filter(a, lambda x, i: not list_contains(a[:i - 1], x)), '|') args from (select call_id, min(arg_exprs) a from calls where arg_exprs is not null group by 1)")
def u05_distinct_in_order(spark, sf):
    """Argument expressions of each call, each once in order of appearance."""
    c = read_table(spark, sf, "calls").where("arg_exprs is not null").groupBy("call_id").agg(F.min("arg_exprs").alias("a"))
    return c.select("call_id", F.array_join(F.array_distinct("a"), "|").alias("args"))


@query("select hint, first_call from (select receiver_expr || '.' || called_name hint, min(call_id) first_call from calls where receiver_expr <> '' and called_name is not null group by 1)")
def u06_distinct_hints(spark, sf):
    """Hint texts, each once, with the first call that gives it; that id is their order."""
    c = read_table(spark, sf, "calls").where("receiver_expr <> '' and called_name is not null")
    return c.groupBy(F.concat_ws(".", "receiver_expr", "called_name").alias("hint")).agg(F.min("call_id").alias("first_call"))


@query("""with recursive l as (select distinct c.name child, p.name parent from extends_edge e join cls c on c.id = e.src join cls p on p.id = e.dst where c.name <> p.name), up as (select child, parent, 1 d from l union select u.child, l.parent, d + 1 from up u join l on l.child = u.parent where d < 32 and u.child <> l.parent)
select child, parent, cast(min(d) as int) as "depth" from (select * from up union all select child, child, 0 from l union all select parent, parent, 0 from l) group by 1, 2""")
def x30_type_depth(spark, sf):
    """Least number of links from each class name up to each of its supertypes."""
    names = lambda end, out: view(spark, sf, "cls").select(F.col("id").alias(end), F.col("name").alias(out))
    links = view(spark, sf, "extends_edge").join(names("src", "child"), "src").join(names("dst", "parent"), "dst").select("child", "parent").distinct()
    return overloads.type_closure(spark, links)


@query("select path, max(version) version, count(*) n_snapshots from (select distinct source_project, branch, last_indexed_at, version, unnest(map_keys(files)) path from fingerprint_files where files is not null) group by 1")
def s21_fingerprints(spark, sf):
    """Stored fingerprints by path: the last version that holds it and in how many snapshots it is."""
    f = read_table(spark, sf, "fingerprint_files").where("files is not null").select("source_project", "branch", "last_indexed_at", "version", F.explode(F.map_keys("files")).alias("path")).distinct()
    return f.groupBy("path").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n_snapshots"))


@query("select source_project, arg_max(language, (n, language)) as \"language\" from (select source_project, lower(language) as \"language\", count(distinct rel_path) n from files where language is not null and source_project is not null group by 1, 2) group by 1")
def s14_primary_language(spark, sf):
    """Language of most files of a project; of several the greater name."""
    n = read_table(spark, sf, "files").where("language is not null and source_project is not null").groupBy("source_project", F.lower("language").alias("language")).agg(F.countDistinct("rel_path").alias("n"))
    return n.groupBy("source_project").agg(F.max(F.struct("n", "language")).alias("m")).select("source_project", F.col("m.language").alias("language"))


@query("select source_project, count(distinct rel_path) n_files, max(mod_time) last_change, (select count(*) from fn where fn.source_project = f.source_project) n_functions from files f where source_project is not null group by 1")
def s37_projects(spark, sf):
    """Every project with its files, last change and functions."""
    f = read_table(spark, sf, "files").where("source_project is not null").groupBy("source_project").agg(F.countDistinct("rel_path").alias("n_files"), F.max("mod_time").alias("last_change"))
    n = view(spark, sf, "fn").groupBy("source_project").agg(F.count(F.lit(1)).alias("n_functions"))
    return f.join(n, "source_project", "left").fillna(0, ["n_functions"])


@query("""with s as (select distinct source_project p, branch b, last_indexed_at t, last_commit c from fingerprint_files), k as (select p, b, t, c, row_number() over (partition by p, b order by t desc, c desc nulls last) n from s), last as (select * from k where n = 1), prev as (select * from k where n = 2)
select last.p source_project, last.b branch, coalesce(prev.c, '') = '' or coalesce(last.c, '') = '' or prev.c <> last.c stale, case when prev.p is null then 'not_indexed' when coalesce(prev.c, '') = '' or coalesce(last.c, '') = '' or prev.c <> last.c then 'new_commits' else '' end reason from last left join prev on prev.p = last.p and prev.b is not distinct from last.b""")
def n08_staleness(spark, sf):
    """Whether the index before the last one of a branch still holds: not indexed, new commits (or no commit on record to
    compare with), or neither. The last snapshot stands for the branch as it is now."""
    s = read_table(spark, sf, "fingerprint_files").select(F.col("source_project").alias("p"), F.col("branch").alias("b"), F.col("last_indexed_at").alias("t"), F.col("last_commit").alias("c")).distinct()
    w = Window.partitionBy("p", "b").orderBy(F.desc("t"), F.desc_nulls_last("c"))
    k = s.withColumn("n", F.row_number().over(w)).where("n <= 2")
    both = k.groupBy("p", "b").agg(F.max(F.when(F.col("n") == 1, F.col("c"))).alias("now"), F.max(F.when(F.col("n") == 2, F.col("c"))).alias("then"), F.max("n").alias("n"))
    stale = (F.coalesce("then", F.lit("")) == "") | (F.coalesce("now", F.lit("")) == "") | (F.col("then") != F.col("now"))
    return both.select(F.col("p").alias("source_project"), F.col("b").alias("branch"), stale.alias("stale"), F.when(F.col("n") == 1, "not_indexed").when(stale, "new_commits").otherwise("").alias("reason"))


# Annotations that make a function an entry point.
ENTRY_TYPES = {"Scheduled": "scheduled_task", "EventListener": "event_handler", "TransactionalEventListener": "event_handler", "KafkaListener": "event_handler", "RabbitListener": "event_handler", "DubboService": "rpc_handler", "GrpcService": "rpc_handler", "Cron": "scheduled_task", "XxlJob": "scheduled_task", "RocketMQMessageListener": "event_handler", "Subscribe": "event_handler"}
_ENTRY = "case " + " ".join(f"when x = '{k}' then '{v}'" for k, v in ENTRY_TYPES.items()) + " end"


@query(f"""with a as (select id, json_extract_string(j, '$.name') n from (select id, unnest(cast(coalesce(annotations, '[]') as json[])) j from fn)), b as (select id, n, case when len(string_split(m, '.')) >= 3 then string_split(m, '.')[-1] else m end x from (select id, n, trim(string_split(ltrim(n, '@'), '(')[1]) m from a))
select distinct id, n annotation, coalesce({_ENTRY}, '') entry_type from b where n is not null""")
def n03_annotation_entries(spark, sf):
    """Annotations of each function with the entry type they stand for, '' for others."""
    types = F.create_map(*[x for k, v in ENTRY_TYPES.items() for x in (F.lit(k), F.lit(v))])
    a = view(spark, sf, "fn").select("id", F.explode(F.from_json("annotations", "array<struct<name:string>>")).alias("a")).select("id", F.col("a.name").alias("annotation")).where("annotation is not null")
    return a.select("id", "annotation", F.coalesce(types[F.trim(S.annotation_base(F.col("annotation")))], F.lit("")).alias("entry_type")).distinct()


@query("select p.source_project, last_indexed > coalesce(last_analysed, 0) needed from (select source_project, max(last_indexed_at) last_indexed from fingerprint_files group by 1) p left join (select source_project, max(last_indexed_at) last_analysed from fingerprint_files where version < 2 group by 1) a on a.source_project is not distinct from p.source_project")
def n07_needs_analysis(spark, sf):
    """Projects indexed after their last analysis; snapshots of the first version stand for analysed ones."""
    f = read_table(spark, sf, "fingerprint_files")
    last = f.groupBy("source_project").agg(F.max("last_indexed_at").alias("indexed"), F.max(F.when(F.col("version") < 2, F.col("last_indexed_at"))).alias("analysed"))
    return last.select("source_project", (F.col("indexed") > F.coalesce("analysed", F.lit(0))).alias("needed"))


# ---- Scalars over several columns

# Annotations worth keeping, by framework (_always and _test hold everywhere), with their category.
ANNOTATIONS = {
    "spring": {"RestController": "layer", "Controller": "layer", "Service": "layer", "Repository": "layer", "Component": "layer", "Configuration": "layer", "Entity": "layer", "Table": "layer", "MappedSuperclass": "layer", "Transactional": "transaction", "Async": "async", "Scheduled": "scheduled", "Cacheable": "cache", "CacheEvict": "cache", "EventListener": "event_listener", "TransactionalEventListener": "event_listener", "KafkaListener": "event_listener", "RabbitListener": "event_listener", "PostConstruct": "lifecycle", "PreDestroy": "lifecycle", "PreAuthorize": "security", "Secured": "security", "RolesAllowed": "security", "Value": "config", "ConditionalOnProperty": "config", "Profile": "config"},
    "mybatis": {"Mapper": "layer", "Select": "query", "Insert": "query", "Update": "query", "Delete": "query"},
    "hibernate": {"Entity": "layer"},
    "dubbo": {"DubboService": "rpc", "GrpcService": "rpc", "DubboReference": "rpc"},
    "graphql": {"QueryMapping": "graphql", "MutationMapping": "graphql", "SubscriptionMapping": "graphql"},
    "nestjs": {"Controller": "layer", "Injectable": "layer", "Module": "layer", "Guard": "security", "UseGuards": "security", "Cron": "scheduled"},
    "fastapi": {"Depends": "dependency"}, "xxl-job": {"XxlJob": "scheduled"}, "rocketmq": {"RocketMQMessageListener": "event_listener"}, "guava": {"Subscribe": "event_listener"}, "swagger2": {"ApiOperation": "doc"}, "swagger3": {"Operation": "doc"},
    "_test": {"Test": "test", "SpringBootTest": "test", "MockBean": "test"}, "_always": {"Deprecated": "lifecycle"},
}


def whitelist(frameworks: list[str], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> dict[str, str]:
    """Annotations (name: category) that the frameworks make worth keeping; later frameworks override, included names are
    custom unless known, excluded ones go."""
    out: dict[str, str] = {}
    for f in ("_always", "_test", *frameworks):
        out |= ANNOTATIONS.get(f, {})
    return {k: v for k, v in ({n: "custom" for n in include} | out).items() if k not in exclude}


@query("select distinct c.id, a.n annotation, case a.n when 'Service' then 'layer' else 'custom' end category from cls c, (select id, json_extract_string(j, '$.name') n from (select id, unnest(cast(coalesce(annotations, '[]') as json[])) j from cls)) a where a.id = c.id and a.n in ('Service', 'Marker')")
def x21_whitelisted(spark, sf):
    """Class annotations that the whitelist of a project keeps, with their category."""
    kept = whitelist(["spring"], ("Marker",), ("Table",))
    table = F.create_map(*[x for k, v in kept.items() for x in (F.lit(k), F.lit(v))])
    a = view(spark, sf, "cls").select("id", F.explode(F.from_json("annotations", "array<struct<name:string>>")).alias("a")).select("id", F.col("a.name").alias("annotation"))
    return a.select("id", "annotation", table[F.col("annotation")].alias("category")).where("category is not null").distinct()


@query(f"select distinct x name, coalesce({_ENTRY}, '') entry_type from (select unnest(['Scheduled', 'KafkaListener', 'XxlJob', 'DubboService']) x union all select name from annotation)")
def x22_entry_types(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("Scheduled", "KafkaListener", "XxlJob", "DubboService")], "name string").unionByName(view(spark, sf, "annotation").select("name")).distinct()
    types = F.create_map(*[x for k, v in ENTRY_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return names.select("name", F.coalesce(types[F.col("name")], F.lit("")).alias("entry_type"))


_LATEST = "f as (select id, name, coalesce(is_static, false) st, json_array_length(cast(coalesce(nullif(params, ''), '[]') as json))::int np, coalesce(len(return_types), 0) nr, coalesce(len(return_types) = 0 or return_types = ['void'], true) vo, coalesce(complexity, 1) c, end_line - start_line d from (select *, row_number() over (partition by id order by indexed_at desc, deleted_at desc nulls first) rn from function_nodes where id is not null) where rn = 1 and deleted_at is null)"


@query(f"with {_LATEST} select id, (not st and np = 0 and nr > 0 and (starts_with(name, 'get') or starts_with(name, 'is')) and length(name) > 3 and c <= 1 and d <= 2) getter, (not st and np = 1 and starts_with(name, 'set') and length(name) > 3 and vo and c <= 1 and d <= 2) setter from f where name is not null and d is not null")
def x32_accessors(spark, sf):
    """Whether a function's shape is that of a getter or setter."""
    w = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc_nulls_first("deleted_at"))
    f = read_table(spark, sf, "function_nodes").where("id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1 and deleted_at is null and name is not null and end_line is not null and start_line is not null")
    f = _arity(f)
    returns = F.coalesce("return_types", F.array().cast("array<string>"))
    nothing = (F.size(returns) == 0) | ((F.size(returns) == 1) & (F.try_element_at(returns, F.lit(1)) == "void"))
    static, c, d = F.coalesce("is_static", F.lit(False)), F.coalesce("complexity", F.lit(1)), F.col("end_line") - F.col("start_line")
    return f.select("id", S.is_getter(F.col("name"), static, F.size("parsed"), F.size(returns), c, d).alias("getter"), S.is_setter(F.col("name"), static, F.size("parsed"), nothing, c, d).alias("setter"))


@query("select id, case when coalesce(params, '') = '' then '[]' else params end json from fn")
def x42_json_round_trip(spark, sf):
    """Parameter lists read and written again as JSON."""
    return _arity(view(spark, sf, "fn")).select("id", F.to_json("parsed").alias("json"))


@query("select c.id, case when c.name like 'B%' then 'POST' else '' end method, case when c.name like 'B%' then '/' || c.name else '' end path from cls c where name is not null")
def x43_route_of_annotations(spark, sf):
    """Verb and path of the first mapping annotation; here classes that begin with B carry one."""
    named = F.when(F.col("name").startswith("B"), F.array(F.lit("Service"), F.lit("PostMapping"))).otherwise(F.array(F.lit("Service")))
    c = view(spark, sf, "cls").where("name is not null").select("id", S.route_of_annotations(named, F.array(F.lit(""), F.concat(F.lit("/"), "name"))).alias("r"))
    return c.select("id", "r.method", "r.path")


@query()
def x44_staleness_messages(spark, sf):
    """Warning of every branch's index."""
    n = n08_staleness(spark, sf)
    return n.select("source_project", "branch", S.staleness_message(F.col("reason"), F.lit("0123456789"), F.lit("abcdefghij"), F.lit(0), F.lit(0), F.lit(0)).alias("message"))


SQL["x44_staleness_messages"] = f"select source_project, branch, case reason when 'not_indexed' then 'Index not found. Run index_repository to build the index.' when 'new_commits' then 'Index outdated: branch has new commits (indexed: 0123456, current: abcdefg). Consider re-indexing.' else '' end message from ({SQL['n08_staleness']}) n"


@query("select id, list_filter([regexp_extract(trim(sql_text), '(?i)^update\\s+([^\\s,();]+)', 1), regexp_extract(' ' || trim(sql_text) || ' ', '(?i) from +([^\\s,();]+)', 1), regexp_extract(' ' || trim(sql_text) || ' ', '(?i) into +([^\\s,();]+)', 1), regexp_extract(' ' || trim(sql_text) || ' ', '(?i) join +([^\\s,();]+)', 1)], lambda x: x <> '')[1] first_table, len(string_split(sql_text, '=')) - 1 n_conditions from query_node")
def x45_query_nodes(spark, sf):
    """Stored queries with their tables as a list and their conditions counted."""
    tables = S.sql_tables(F.col("sql_text"))
    return view(spark, sf, "query_node").select("id", F.try_element_at(tables, F.lit(1)).alias("first_table"), (F.size(F.split("sql_text", "=")) - 1).cast("long").alias("n_conditions"))


@query("select call_id, list_has_all(arg_types, ['string', 'int']) value from (select call_id, min(arg_types) arg_types from calls where arg_types is not null group by 1)")
def u04_subset(spark, sf):
    """Whether a call's argument types hold all of a required set."""
    c = read_table(spark, sf, "calls").where("arg_types is not null").groupBy("call_id").agg(F.min("arg_types").alias("a"))
    return c.select("call_id", L.is_subset(F.array(F.lit("string"), F.lit("int")), F.col("a")).alias("value"))


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL
