"""Views that project the tables into the graph schema, as SQL that Spark and other engines both accept.

`view(spark, sf_dir, name)` gives a DataFrame, `with_views(sql)` an oracle query with the views it names in front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skein.storage import read_table

# In dependency order. Latest state of a record: its last indexed row, if that is not deleted.
VIEWS: dict[str, str] = {
    "fn": """select id, name, qualified_name, file_path, start_line, end_line, params, annotations, coalesce(is_getter, false) is_getter, coalesce(is_setter, false) is_setter,
  coalesce(is_constructor, false) is_constructor, coalesce(is_static, false) is_static, complexity, class_type, source_project, entry_type
  from (select *, row_number() over (partition by id order by indexed_at desc, deleted_at desc nulls first) rn from function_nodes where id is not null) where rn = 1 and deleted_at is null""",
    "cls": """select id, name, qualified_name, file_path, start_line, end_line, class_type, annotations, fields, is_abstract, source_project
  from (select *, row_number() over (partition by id order by indexed_at desc) rn from class_nodes where id is not null) where rn = 1""",
    "call_edge": """select distinct edge_id, source_id src, target_id dst, confidence, line, declared_type, chain_id, chain_depth, flow_context, resolved_by, candidates
  from edges where kind = 'CALLS' and source_id in (select id from fn) and target_id in (select id from fn)""",
    "dispatch_edge": """select distinct edge_id, source_id src, target_id dst, confidence from edges where kind = 'DISPATCHES' and source_id in (select id from fn) and target_id in (select id from fn)""",
    "extends_edge": """select source_id src, min(target_id) dst from edges where kind = 'EXTENDS' and source_id in (select id from cls) and target_id in (select id from cls) and source_id <> target_id group by source_id""",
    # A function for each of 4096 buckets; a row of another table goes to the bucket of its own key's hash, if that has one.
    "fn_no": """select substr(md5(id), 1, 3) b, min(id) id from fn group by substr(md5(id), 1, 3)""",
    "route_raw": """select o_orderkey k, case cast(floor(o_orderkey / 10) as int) % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' when 3 then 'CLI' else 'DELETE' end method,
  case when cast(floor(o_orderkey / 10) as int) % 5 = 3 then 'job-' || cast(o_orderkey % 97 as string) else '/' || lower(o_orderstatus) || '/v' || cast(o_orderkey % 3 as string) || case when o_orderkey % 7 = 0 then '/**' else '/item/' || cast(o_orderkey % 53 as string) end end path,
  case when o_orderkey % 30 = 0 then 'feign' when o_orderkey % 30 = 10 then 'grpc' else 'spring' end framework from orders""",
    "route": """select 'route:' || cast(k as string) id, k, method, path, framework from route_raw""",
    "handles": """select f.id src, r.id dst, 1 handler_order from route r join fn_no f on f.b = substr(md5(cast(r.k * 7 as string)), 1, 3)
  union all select f.id, r.id, 0 from route r join fn_no f on f.b = substr(md5(cast(r.k * 11 as string)), 1, 3) where r.k % 3 = 0""",
    "query_node": """select 'query:' || cast(o_orderkey as string) id, o_orderkey k, case o_orderstatus when 'F' then 'SELECT a, b FROM customer JOIN nation ON c = n WHERE k = ' || cast(o_orderkey as string)
  when 'O' then 'INSERT INTO audit_log (a) VALUES (1)' else '  update stock SET q = 1 where id = 5' end sql_text from orders""",
    "executes": """select f.id src, q.id dst from query_node q join fn_no f on f.b = substr(md5(cast(q.k * 13 as string)), 1, 3)""",
    "variable": """select distinct 'var:' || c_mktsegment id, c_mktsegment name, 'com.Segment.' || c_mktsegment qualified_name from customer""",
    "uses": """select f.id src, 'var:' || c.c_mktsegment dst, cast(o.o_orderkey % 200 as int) line, case when o.o_orderpriority < '3' then 'switch_case' else 'field_access' end ref_kind
  from orders o join customer c on c.c_custkey = o.o_custkey join fn_no f on f.b = substr(md5(cast(o.o_orderkey * 17 as string)), 1, 3)""",
    "annotation": """select id || '::' || a name_id, id owner, a name, case a when 'RestController' then 'controller' when 'Service' then 'service' when 'Repository' then 'repository' when 'Entity' then 'model' else 'component' end layer,
  case a when 'RestController' then 'route' when 'Repository' then 'orm' else 'component' end category
  from (select id, case length(name) % 5 when 0 then 'RestController' when 1 then 'Service' when 2 then 'Repository' when 3 then 'Entity' else 'Component' end a from cls)""",
    "remote_call": """select l_orderkey k, l_linenumber line, f.id caller, case l_linenumber % 4 when 0 then '' when 1 then 'get' when 2 then 'POST' else 'PUT' end method,
  '/' || lower(case l_linestatus when 'F' then 'f' else 'o' end) || '/v' || cast(l_orderkey % 3 as string) || '/item/' || cast(l_partkey % 53 as string) path, l_suppkey service
  from lineitem join fn_no f on f.b = substr(md5(cast(l_partkey * 19 as string)), 1, 3)""",
    "import_edge": """select distinct a.file_path src, b.file_path dst from call_edge e join fn a on a.id = e.src join fn b on b.id = e.dst where a.file_path <> b.file_path""",
    "url": """select event_id id, case event_id % 7 when 0 then 'https://svc' || cast(user_id as string) || ':8080/v1/item/' || cast(event_id as string) || '?x=1' when 1 then '/v1/:key/' || cast(event_id as string)
  when 2 then 'http://127.0.0.1/p' when 3 then '' when 4 then '`http://pay.local/a/' || chr(123) || 'id' || chr(125) || '/b#f`' when 5 then 'base + "/x"' else ' api/v' || cast(user_id as string) || '/<name>/list' end s from events""",
    "type_text": """select l_orderkey * 8 + l_linenumber id, case l_linenumber when 1 then 'Optional[A]' when 2 then 'A | null' when 3 then 'A | B' when 4 then 'None' when 5 then 'com.x.Type' when 6 then 'NewPayServiceClient' else 'PayServiceStub' end s from lineitem""",
}
BASE = ("function_nodes", "class_nodes", "edges", "calls", "heritage", "files", "fingerprint_files", "external_symbols", "index_errors", "orders", "customer", "lineitem", "part", "supplier", "nation", "region", "events", "documents", "embeddings")


def _used(sql: str) -> list[str]:
    """Views that a query names, directly or through other views, in dependency order."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    return [n for n in VIEWS if n in need]


def with_views(sql: str) -> str:
    views = _used(sql)
    if not views:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in views)
    body = sql.lstrip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        return f"with {'recursive ' if recursive else ''}{ctes},\n{re.sub(r'^with( recursive)?', '', body, flags=re.I)}"
    return f"with {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"select * from {name}")
    tables = [t for t in BASE if re.search(rf"\b{t}\b", sql)]
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})
