"""Call resolution over receivers: one query per strategy, and all of them ranked."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view, with_views
from skein.operators import receivers as R
from skein.operators.traverse import ancestors
from skein.storage import Scratch, read_table

Q: dict = {}
SQL: dict = {}
_TYPE = "array<struct<name:string,type:string,has_default:boolean>>"
_OWNER = "regexp_replace({}, '\\.[^.]*$', '')"
_CALLS = "c as (select distinct call_id, called_name, caller_name, file_path, arg_count, coalesce(receiver_expr, '') receiver from calls where called_name is not null)"
_M = f"m as (select f.id, f.name, k.id owner, f.file_path from fn f join cls k on k.qualified_name = {_OWNER.format('f.qualified_name')})"
_UP = "up as (select id, a, min(l) l from (with recursive u as (select src id, dst a, 1 l from extends_edge union all select u.id, e.dst, l + 1 from u join extends_edge e on e.src = u.a where l < 5) select * from u) where id <> a group by 1, 2)"
_OWN = f"own as (select call_id, min(k.id) own from c join cls k on k.qualified_name = {_OWNER.format('c.caller_name')} group by 1)"
_TYPES = """f1 as (select c.*, own.own, regexp_extract(receiver, '^(?:(?:this|self)\\.)?([A-Za-z_$][\\w$]*)$', 1) v from c left join own using (call_id) where receiver <> ''),
fld as (select distinct id, json_extract_string(x, '$.name') v, json_extract_string(x, '$.type') t from (select id, unnest(cast(fields as json[])) x from cls where fields is not null)),
par as (select distinct qualified_name q, json_extract_string(x, '$.name') v, json_extract_string(x, '$.type') t from (select qualified_name, unnest(cast(cast(coalesce(nullif(params, ''), '[]') as json) as json[])) x from fn)),
upf as (select up.id, fld.v, min((l, fld.t)) m from up join fld on fld.id = up.a group by 1, 2),
n1 as (select * from f1 where v <> '' and receiver not in ('this', 'self', 'super')),
ty as (select call_id, file_path, t, 1 r from n1 join par on par.q = n1.caller_name and par.v = n1.v where not contains(receiver, '.') union all select call_id, file_path, t, 2 from n1 join fld on fld.id = own and fld.v = n1.v
 union all select call_id, file_path, m[2], 3 from n1 join upf on upf.id = own and upf.v = n1.v union all select call_id, file_path, v, 4 from n1 where not contains(receiver, '.') and ascii(v) between 65 and 90),
tk as (select call_id, own k, 0 r, 0 near from f1 where receiver in ('this', 'self') and own is not null union all select call_id, k.id, r, case when k.file_path = ty.file_path then 0 when k.source_project = string_split(ty.file_path, '/')[1] then 1 else 2 end from ty join cls k on k.name = regexp_extract(regexp_replace(regexp_replace(t, '^[*&\\[\\]]+', ''), '[<\\[?].*$', ''), '[^.]*$')),
types as (select call_id, min((r, near, k)) m from tk group by 1)"""


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


def _calls(spark, sf):
    return read_table(spark, sf, "calls").where("called_name is not null").select("call_id", "called_name", "caller_name", "file_path", "arg_count", F.coalesce("receiver_expr", F.lit("")).alias("receiver")).distinct()


def _functions(spark, sf):
    parsed = F.coalesce(F.from_json(F.nullif("params", F.lit("")), _TYPE), F.array().cast(_TYPE))
    return view(spark, sf, "fn").select("id", "name", "qualified_name", "file_path", parsed.alias("parsed"))


def _methods(spark, sf):
    owner = S.owner_name(F.col("qualified_name")).alias("qualified_name")
    return view(spark, sf, "fn").select("id", "name", "file_path", owner).join(view(spark, sf, "cls").select(F.col("id").alias("owner"), "qualified_name"), "qualified_name").select("id", "name", "owner", "file_path")


def _inherited(spark, sf):
    return ancestors(view(spark, sf, "extends_edge"), 5, Scratch(spark)).select(F.col("id").alias("class_id"), "ancestor", "level")


def _types(spark, sf):
    return R.receiver_types(_calls(spark, sf), _functions(spark, sf), view(spark, sf, "cls"), _inherited(spark, sf))


@query(f"with {_CALLS}, w as (select call_id, called_name n, receiver, case when receiver <> '' then receiver || '.' || called_name else called_name end q from c where called_name not in (select name from fn)), e as (select qualified_name q, min(id) id from external_symbols group by 1), s as (select name n, min(id) id from external_symbols group by 1)\n"
       "select call_id, coalesce(e.id, s.id, case when regexp_matches(receiver, '^[A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)*$') then 'external:' || w.q end) target_id from w left join e on e.q = w.q left join s on s.n = w.n where e.id is not null or s.id is not null or regexp_matches(receiver, '^[A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)*$')")
def c06_external(spark, sf):
    return R.external_targets(_calls(spark, sf), read_table(spark, sf, "external_symbols"), _functions(spark, sf))


@query(f"with {_CALLS}, {_OWN}, {_UP}, {_TYPES} select call_id, m[3] class_id, case m[1] when 0 then 'self' when 1 then 'parameter' when 2 then 'field' when 3 then 'inherited_field' else 'class_name' end source from types")
def c11_receiver_types(spark, sf):
    return _types(spark, sf)


@query(f"with {_CALLS}, {_OWN}, {_UP}, {_TYPES}, {_M}, h as (select t.call_id, m.id, 0 l from types t join c using (call_id) join m on m.owner = t.m[3] and m.name = c.called_name union all select t.call_id, m.id, up.l from types t join c using (call_id) join up on up.id = t.m[3] join m on m.owner = up.a and m.name = c.called_name)\n"
       "select distinct call_id, id from h where (call_id, l) in (select (call_id, min(l)) from h group by call_id)")
def c04_hierarchy_methods(spark, sf):
    """Methods that a call's receiver type defines or inherits: the nearest ones."""
    return R.methods_of_types(_calls(spark, sf), _types(spark, sf), _methods(spark, sf), _inherited(spark, sf)).select("call_id", "id")


_DIS = """p as (select id, file_path, cast(coalesce(nullif(params, ''), '[]') as json) p from fn), j as (select k.call_id, k.id, p.file_path = c.file_path near, coalesce(case when json_array_length(p)::int > 0 and ends_with(coalesce(json_extract_string(p, '$[' || greatest(json_array_length(p)::int - 1, 0) || '].type'), ''), '...') then c.arg_count >= json_array_length(p)::int - 1
 else c.arg_count between json_array_length(p)::int - coalesce(len(list_filter(cast(json_extract(p, '$[*].has_default') as boolean[]), lambda x: x)), 0) and json_array_length(p)::int end, false) fits from k join p on p.id = k.id join (select call_id, min(file_path) file_path, min(arg_count) arg_count from c group by 1) c on c.call_id = k.call_id),
n as (select *, count(*) over (partition by call_id) n, sum(near::int) over (partition by call_id) nn, sum(fits::int) over (partition by call_id) nf from j), h as (select *, case when n = 1 then 'EXACT' when nn = 1 then 'type_same_file' when nf = 1 then 'arg_count' else 'type_multi' end how from n)
select call_id, id target_id, how resolved_by, cast(case how when 'EXACT' then CONF when 'type_multi' then 0.65 / (case when nf > 0 then nf else n end) else 0.85 end as double) confidence, case when how = 'type_multi' then case when nf > 0 then nf else n end else 1 end candidates
from h where case how when 'type_same_file' then near when 'arg_count' then fits when 'type_multi' then nf = 0 or fits else true end"""


@query(f"with {_CALLS}, k as (select distinct c.call_id, f.id from c join fn f on f.name = c.called_name), {_DIS.replace('EXACT', 'type_exact').replace('CONF', '0.95')}")
def c05_disambiguation(spark, sf):
    """Edges out of all functions of a call's name: exact, by file, by number of arguments, or all that are left."""
    c, f = _calls(spark, sf), _functions(spark, sf)
    return R.disambiguate(c, c.select("call_id", F.col("called_name").alias("name")).join(f.select("id", "name"), "name"), f)


@query(f"with {_CALLS} select distinct c.call_id, f.id from c join fn f on f.name = c.called_name and regexp_replace(f.qualified_name, '\\.[^.]*\\.[^.]*$', '') = regexp_replace(c.caller_name, '\\.[^.]*\\.[^.]*$', '')")
def c07_same_package(spark, sf):
    return R.same_package(_calls(spark, sf), _functions(spark, sf))


@query(f"with {_CALLS}, {_OWN}, {_UP}, {_M}, h as (select c.call_id, min((up.l, m.id)) x from c join own using (call_id) join up on up.id = own.own join m on m.owner = up.a and m.name = c.called_name where regexp_matches(c.receiver, '^super(\\(.*\\))?$') group by 1) select call_id, x[2] id from h")
def c20_super_calls(spark, sf):
    return R.super_calls(_calls(spark, sf), _methods(spark, sf), view(spark, sf, "cls"), _inherited(spark, sf))


@query("with a as (select distinct call_id, file_path, unnest(arg_exprs) a from calls), b as (select call_id, file_path, regexp_extract(a, '^(?:[\\w$]+::|this\\.|self\\.)?([A-Za-z_$][\\w$]*)$', 1) n from a) select distinct call_id, f.id from b join fn f on f.name = n and f.file_path = b.file_path where n <> ''")
def c16_callbacks(spark, sf):
    return R.callback_references(read_table(spark, sf, "calls").select("call_id", "file_path", "arg_exprs"), _functions(spark, sf))


@query("""select x.name, x.file_path, x.m[2] class_id from (select w.name, w.file_path, min((case when k.file_path = w.file_path then 0 when k.source_project = string_split(w.file_path, '/')[1] then 1 else 2 end, k.id)) m from (select distinct parent_name name, file_path from heritage where parent_name is not null) w join cls k on k.name = w.name group by 1, 2) x""")
def c14_qualified_types(spark, sf):
    """Class that a type name means in a file: one of the file, of the project, else the least of all."""
    w = read_table(spark, sf, "heritage").where("parent_name is not null").select(F.col("parent_name").alias("name"), "file_path").distinct()
    k = view(spark, sf, "cls").select("name", F.col("id").alias("class_id"), F.col("file_path").alias("f"), "source_project")
    near = F.when(F.col("f") == F.col("file_path"), 0).when(F.substring_index("file_path", "/", 1) == F.col("source_project"), 1).otherwise(2)
    best = w.join(k, "name").groupBy("name", "file_path").agg(F.min(F.struct(near.alias("near"), "class_id")).alias("m"))
    return best.select("name", "file_path", F.col("m.class_id").alias("class_id"))


@query("""with p as (select id, unnest(type_params) t, generate_subscripts(type_params, 1) i from (select distinct id, type_params from class_nodes where type_params is not null)), h as (select distinct child_name, file_path, parent_name, unnest(type_args) a, generate_subscripts(type_args, 1) i from heritage where type_args is not null)
select h.child_name child, h.file_path, p.id parent_id, p.t parameter, h.a argument from h join cls k on k.name = h.parent_name join p on p.id = k.id and p.i = h.i""")
def c13_type_arguments(spark, sf):
    """What each type parameter of a parent class stands for in a child: its parameters and the link's arguments by place."""
    p = read_table(spark, sf, "class_nodes").where("type_params is not null").select("id", "type_params").distinct().select("id", F.posexplode("type_params").alias("i", "parameter"))
    h = read_table(spark, sf, "heritage").where("type_args is not null").select(F.col("child_name").alias("child"), "file_path", "parent_name", "type_args").distinct().select("child", "file_path", "parent_name", F.posexplode("type_args").alias("i", "argument")).distinct()
    k = view(spark, sf, "cls").select(F.col("id"), F.col("name").alias("parent_name"))
    return h.join(k, "parent_name").join(p, ["id", "i"]).select("child", "file_path", F.col("id").alias("parent_id"), "parameter", "argument")


@query("""with t as (select distinct name, string_split(lower(rt), '<')[1] base, rt from (select name, unnest(return_types) rt from function_nodes where return_types is not null) where rt <> '')
select name, case when count(distinct rt) = 1 then min(rt) else '' end return_type, case when count(distinct rt) = 1 and regexp_matches(min(rt), '^[A-Za-z.]+<.*>$') then case when ends_with(lower(string_split(min(rt), '<')[1]), 'map') then trim(regexp_extract(min(rt), '^[^<]*<[^,]*,(.*)>$', 1)) else regexp_extract(min(rt), '^[^<]*<(.*)>$', 1) end else '' end element_type from t group by 1""")
def c30_return_types(spark, sf):
    """Return type of each function name where all functions of the name agree, and the element type of containers."""
    r = read_table(spark, sf, "function_nodes").where("return_types is not null").select("name", F.explode("return_types").alias("rt")).where("rt <> ''").distinct()
    t = r.groupBy("name").agg(F.countDistinct("rt").alias("n"), F.min("rt").alias("rt"))
    only = F.when(F.col("n") == 1, F.col("rt")).otherwise("")
    value = F.trim(F.regexp_extract("rt", r"^[^<]*<[^,]*,(.*)>$", 1))
    element = F.when((F.col("n") == 1) & F.col("rt").rlike(r"^[A-Za-z.]+<.*>$"), F.when(F.lower(F.substring_index("rt", "<", 1)).endswith("map"), value).otherwise(F.regexp_extract("rt", r"^[^<]*<(.*)>$", 1))).otherwise("")
    return t.select("name", only.alias("return_type"), element.alias("element_type"))


@query("select id, i - 1 as \"position\", return_types[i] return_type from (select id, return_types, unnest(range(1, len(return_types) + 1)) i from (select distinct id, return_types from function_nodes where id is not null and return_types is not null))")
def c29_multi_return(spark, sf):
    """Types of each value that a function returns, by position."""
    r = read_table(spark, sf, "function_nodes").where("id is not null and return_types is not null").select("id", "return_types").distinct()
    return r.select("id", F.posexplode("return_types").alias("position", "return_type")).select("id", F.col("position").cast("long").alias("position"), "return_type")


@query("""with s as (select distinct scope, var from (select caller_name scope, string_split(receiver_expr, '.')[1] var from calls where receiver_expr <> '' and caller_name is not null)), par as (select distinct qualified_name q, json_extract_string(x, '$.name') v, json_extract_string(x, '$.type') t from (select qualified_name, unnest(cast(cast(coalesce(nullif(params, ''), '[]') as json) as json[])) x from fn)),
fld as (select distinct qualified_name q, json_extract_string(x, '$.name') v, json_extract_string(x, '$.type') t from (select qualified_name, unnest(cast(fields as json[])) x from cls where fields is not null)), b as (select * from par union select * from fld),
h as (select s.scope, s.var, b.t, length(b.q) n from s join b on b.v = s.var and (b.q = s.scope or starts_with(s.scope, b.q || '.'))) select scope, var, max((n, t))[2] as "type" from h group by 1, 2""")
def c28_scope_chain(spark, sf):
    """Type of a variable in a scope: the binding in the nearest enclosing scope (function parameters, class fields)."""
    s = read_table(spark, sf, "calls").where("receiver_expr <> '' and caller_name is not null").select(F.col("caller_name").alias("scope"), F.substring_index("receiver_expr", ".", 1).alias("var")).distinct()
    par = _functions(spark, sf).select(F.col("qualified_name").alias("q"), F.explode("parsed").alias("p")).select("q", F.col("p.name").alias("var"), F.col("p.type").alias("type"))
    from skein.operators.lookups import fields_of

    cls = view(spark, sf, "cls")
    fld = fields_of(cls).join(cls.select(F.col("id").alias("class_id"), F.col("qualified_name").alias("q")), "class_id").select("q", F.col("field").alias("var"), "type")
    parts = F.split("scope", r"\.")
    heads = s.select("scope", "var", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("q"))
    hit = heads.join(par.unionByName(fld).distinct(), ["q", "var"])
    return hit.groupBy("scope", "var").agg(F.max(F.struct(F.length("q").alias("n"), "type")).alias("m")).select("scope", "var", F.col("m.type").alias("type"))


def c03_resolve_ranked(spark, sf):
    """Edges of all calls over their receivers, the first strategy with candidates counting; tests compare with fixtures."""
    return R.resolve_ranked(_calls(spark, sf), _functions(spark, sf), view(spark, sf, "cls"), _inherited(spark, sf), read_table(spark, sf, "external_symbols"))


Q["c03_resolve_ranked"] = c03_resolve_ranked


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL
