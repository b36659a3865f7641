"""Lookups, search, paging, sets and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.lens import view, with_views
from skein.operators import lookups as L
from skein.operators.lookup import lookup_join
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


_FN = "id, name, qualified_name, file_path"


def _cols(df):
    return df.select("id", "name", "qualified_name", "file_path")


@query(f"select {_FN} from fn where id = (select min(id) from fn)")
def f01_by_id(spark, sf):
    fn = view(spark, sf, "fn")
    return _cols(fn.join(F.broadcast(fn.agg(F.min("id").alias("id"))), "id"))  # one row


@query(f"select {_FN} from fn where name = '__init__'")
def f03_by_name(spark, sf):
    return _cols(L.by_name(view(spark, sf, "fn"), "__init__"))


@query("select id, 'Function' kind from fn union all select id, 'Class' from cls")
def f04_by_kind(spark, sf):
    return view(spark, sf, "fn").select("id", F.lit("Function").alias("kind")).unionByName(view(spark, sf, "cls").select("id", F.lit("Class").alias("kind")))


@query(f"select {_FN} from fn where contains(qualified_name, 'Report')")
def f05_contains(spark, sf):
    return _cols(L.by_property(view(spark, sf, "fn"), "qualified_name", "Report", "contains"))


@query(f"select {_FN} from fn where entry_type <> ''")
def f05_not_empty(spark, sf):
    return _cols(L.by_property(view(spark, sf, "fn"), "entry_type", mode="not_empty"))


@query("select file_path, id, start_line, end_line from (select file_path, id, start_line, end_line from fn union all select file_path, id, start_line, end_line from cls) where start_line is not null and end_line is not null")
def f06_by_file(spark, sf):
    part = lambda v: view(spark, sf, v).select("file_path", "id", "start_line", "end_line")
    return part("fn").unionByName(part("cls")).where("start_line is not null and end_line is not null")


@query(f"select {_FN} from fn where id in (select dst from call_edge where confidence < 0.5)")
def f07_by_ids(spark, sf):
    ids = view(spark, sf, "call_edge").where("confidence < 0.5").select(F.col("dst").alias("id")).distinct()
    return _cols(view(spark, sf, "fn").join(ids, "id", "left_semi"))


@query("select id, src, dst from (select src id, src, dst from call_edge union all select dst, src, dst from call_edge where src <> dst)")
def f08_edges_of_node(spark, sf):
    e = view(spark, sf, "call_edge").select("src", "dst")
    return e.select(F.col("src").alias("id"), "src", "dst").unionByName(e.where("src <> dst").select(F.col("dst").alias("id"), "src", "dst"))


@query("select kind, src, dst, confidence from (select 'CALLS' kind, src, dst, confidence from call_edge union all select 'DISPATCHES', src, dst, confidence from dispatch_edge)")
def f09_all_edges(spark, sf):
    part = lambda k, v: view(spark, sf, v).select(F.lit(k).alias("kind"), "src", "dst", "confidence")
    return part("CALLS", "call_edge").unionByName(part("DISPATCHES", "dispatch_edge"))


@query("""with w as (select distinct called_name t from calls where called_name is not null), h as (select t, id, case when qualified_name = t then 0 when ends_with(qualified_name, '.' || t) then 1 when not contains(t, '.') then 2 end r
  from w join fn on fn.name = string_split(t, '.')[-1]), b as (select t, min(r) r from h where r is not null group by t)
select h.t as "text", h.id, h.r as "rank", count(*) over (partition by h.t) n_candidates from h join b on b.t = h.t and b.r = h.r""")
def f13_resolve(spark, sf):
    wanted = read_table(spark, sf, "calls").where("called_name is not null").select(F.col("called_name").alias("text"))
    return L.resolve(view(spark, sf, "fn"), wanted)


@query("select c.id, c.qualified_name, a.name as annotation from annotation a join cls c on c.id = a.owner where a.name = 'Service'")
def f15_annotation(spark, sf):
    a = view(spark, sf, "annotation").where("name = 'Service'").select(F.col("owner").alias("id"), F.col("name").alias("annotation"))
    return view(spark, sf, "cls").select("id", "qualified_name").join(a, "id")


@query("select c.id, a.layer from annotation a join cls c on c.id = a.owner where a.layer in ('controller', 'model')")
def f16_layer(spark, sf):
    a = view(spark, sf, "annotation").where(F.col("layer").isin("controller", "model")).select(F.col("owner").alias("id"), "layer")
    return view(spark, sf, "cls").select("id").join(a, "id")


@query("select distinct category from annotation")
def f19_categories(spark, sf):
    return view(spark, sf, "annotation").select("category").distinct()


@query("""select c.id class_id, 'method' kind, f.name member from cls c join fn f on regexp_replace(f.qualified_name, '\\.[^.]*$', '') = c.qualified_name
union all select id, 'field', json_extract_string(x, '$.name') from (select id, unnest(cast(fields as json[])) x from cls where fields is not null)""")
def f20_members(spark, sf):
    cls = view(spark, sf, "cls")
    methods = view(spark, sf, "fn").select(F.expr("regexp_replace(qualified_name, '\\\\.[^.]*$', '')").alias("qualified_name"), F.col("name").alias("member"))
    a = cls.select(F.col("id").alias("class_id"), "qualified_name").join(methods, "qualified_name").select("class_id", F.lit("method").alias("kind"), "member")
    return a.unionByName(L.fields_of(cls).select("class_id", F.lit("field").alias("kind"), F.col("field").alias("member")))


@query("select 'Function' kind, id, name, qualified_name, file_path from fn where contains(name, 'Batch') or contains(qualified_name, 'Batch') union all select 'Class', id, name, qualified_name, file_path from cls where contains(name, 'Batch') or contains(qualified_name, 'Batch')")
def f21_search(spark, sf):
    return L.search([("Function", view(spark, sf, "fn")), ("Class", view(spark, sf, "cls"))], "Batch")


@query("select id || '::field::' || json_extract_string(x, '$.name') id, json_extract_string(x, '$.type') as \"type\" from (select id, unnest(cast(fields as json[])) x from cls where fields is not null) where contains(json_extract_string(x, '$.name'), 'a') or contains(json_extract_string(x, '$.type'), 'a')")
def f22_field_hits(spark, sf):
    hits = L.fields_of(view(spark, sf, "cls")).where(F.col("field").contains("a") | F.col("type").contains("a"))
    return hits.select(F.concat_ws("::", "class_id", F.lit("field"), "field").alias("id"), "type")


@query("select v.qualified_name variable, src, min(line) line, arg_min(ref_kind, (line, ref_kind)) ref_kind from uses u join variable v on v.id = u.dst group by 1, 2")
def f23_usages(spark, sf):
    u = view(spark, sf, "uses").join(view(spark, sf, "variable").select(F.col("id").alias("dst"), F.col("qualified_name").alias("variable")), "dst")
    return u.groupBy("variable", "src").agg(F.min(F.struct("line", "ref_kind")).alias("m")).select("variable", "src", "m.line", "m.ref_kind")


@query("select e.src, a.qualified_name from_name, e.dst, b.qualified_name to_name from dispatch_edge e join fn a on a.id = e.src join fn b on b.id = e.dst")
def f25_dependencies(spark, sf):
    fn = view(spark, sf, "fn")
    name = lambda end, out: fn.select(F.col("id").alias(end), F.col("qualified_name").alias(out))
    return view(spark, sf, "dispatch_edge").select("src", "dst").join(name("src", "from_name"), "src").join(name("dst", "to_name"), "dst")


@query("select id, method, path from route where method not in ('CLI', 'TOOL') and upper(method) = 'GET'")
def f26_routes(spark, sf):
    return view(spark, sf, "route").where("method not in ('CLI', 'TOOL') and upper(method) = 'GET'").select("id", "method", "path")


@query("""with w as (select distinct path w from route), e as (select w, id, case when path = w then 0 else 1 end r from w join route on path = w or (contains(path, w) and starts_with(w, '/') and method not in ('CLI', 'TOOL'))),
b as (select w, min(r) r from e group by w) select e.w wanted, e.id, count(*) over (partition by e.w) n_found from e join b on b.w = e.w and b.r = e.r""")
def f27_find_route(spark, sf):
    """Exact paths first, else paths that contain the text, for the path of every route."""
    route = view(spark, sf, "route")
    return _find_route(route, route)


def _find_route(route, asked):
    wanted = asked.select(F.col("path").alias("wanted")).distinct()
    exact = route.join(wanted, F.col("path") == F.col("wanted")).select("wanted", "id")
    rest = wanted.join(exact, "wanted", "left_anti")
    part = route.join(rest, F.col("path").contains(F.col("wanted")) & F.col("wanted").startswith("/") & ~F.col("method").isin("CLI", "TOOL")).select("wanted", "id")
    found = exact.unionByName(part)
    return found.join(found.groupBy("wanted").agg(F.count(F.lit(1)).alias("n_found")), "wanted")


@query("select id, entry_type from fn where entry_type is not null and entry_type <> ''")
def f29_entry_points(spark, sf):
    return view(spark, sf, "fn").where("entry_type is not null and entry_type <> ''").select("id", "entry_type")


@query("select source_project, branch, count(distinct last_indexed_at) n_snapshots, max(last_indexed_at) last_indexed_at from fingerprint_files group by 1, 2")
def f30_projects(spark, sf):
    f = read_table(spark, sf, "fingerprint_files")
    return f.groupBy("source_project", "branch").agg(F.countDistinct("last_indexed_at").alias("n_snapshots"), F.max("last_indexed_at").alias("last_indexed_at"))


@query("select id, (select count(*) from fn) total from fn order by file_path, start_line, id limit 50 offset 100")
def l01_page(spark, sf):
    return L.page(view(spark, sf, "fn").select("id", "file_path", "start_line"), L.ORDER, 100, 50).select("id", "total")


@query("select name from fn union select name from cls")
def u01_union(spark, sf):
    return view(spark, sf, "fn").select("name").union(view(spark, sf, "cls").select("name")).distinct()


@query("select src, dst from call_edge where src not in (select id from fn where source_project = 'onyxvault_00000') union all select src, dst from dispatch_edge where src in (select id from fn where source_project = 'onyxvault_00000')")
def u03_merge(spark, sf):
    """Old relations without those of the affected project, and that project's re-resolved ones."""
    own = view(spark, sf, "fn").where("source_project = 'onyxvault_00000'").select(F.col("id").alias("src"))
    old, new = view(spark, sf, "call_edge").select("src", "dst"), view(spark, sf, "dispatch_edge").select("src", "dst")
    return old.join(own, "src", "left_anti").unionByName(new.join(own, "src", "left_semi"))


@query("select kind, count(*) n from (select 'Function' kind from fn union all select 'Class' from cls union all select 'CALLS' from call_edge union all select 'DISPATCHES' from dispatch_edge union all select 'EXTENDS' from extends_edge union all select 'Route' from route union all select 'QueryNode' from query_node union all select 'Variable' from variable) group by 1")
def a01_stats(spark, sf):
    out = None
    for kind, v in (("Function", "fn"), ("Class", "cls"), ("CALLS", "call_edge"), ("DISPATCHES", "dispatch_edge"), ("EXTENDS", "extends_edge"), ("Route", "route"), ("QueryNode", "query_node"), ("Variable", "variable")):
        one = view(spark, sf, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select 'duplicate id' problem, id from function_nodes group by id having count(*) > 1 union all select 'missing file', id from fn where coalesce(file_path, '') = '' union all select 'empty name', id from fn where coalesce(name, '') = ''""")
def a02_quality(spark, sf):
    fn = view(spark, sf, "fn")
    twice = read_table(spark, sf, "function_nodes").groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), "id")
    bad = lambda c, p: fn.where(F.coalesce(c, F.lit("")) == "").select(F.lit(p).alias("problem"), "id")
    return twice.unionByName(bad("file_path", "missing file")).unionByName(bad("name", "empty name"))


@query("select coalesce(resolved_by, '') resolved_by, count(*) n_calls, sum(case when confidence < 0.5 then 1 else 0 end)::bigint n_low, round(avg(confidence), 6) avg_confidence from call_edge group by 1")
def a04_confidence(spark, sf):
    e = view(spark, sf, "call_edge")
    return e.groupBy(F.coalesce("resolved_by", F.lit("")).alias("resolved_by")).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(F.col("confidence") < 0.5, 1).otherwise(0)).alias("n_low"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query("select entry_type, count(*) n from fn where entry_type <> '' group by 1")
def a03_entry_types(spark, sf):
    return view(spark, sf, "fn").where("entry_type <> ''").groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"))


@query("select kind, source_kind, target_kind, count(*) n from edges where not (kind in ('CALLS', 'DISPATCHES', 'USES') and source_kind = 'Function' and target_kind in ('Function', 'Class', 'Variable') or kind = 'EXTENDS' and source_kind = 'Class' and target_kind = 'Class') or source_kind is null or target_kind is null group by 1, 2, 3")
def a11_endpoint_types(spark, sf):
    ok = F.expr("kind in ('CALLS', 'DISPATCHES', 'USES') and source_kind = 'Function' and target_kind in ('Function', 'Class', 'Variable') or kind = 'EXTENDS' and source_kind = 'Class' and target_kind = 'Class'")
    e = read_table(spark, sf, "edges").where(~ok | F.col("source_kind").isNull() | F.col("target_kind").isNull())
    return e.groupBy("kind", "source_kind", "target_kind").agg(F.count(F.lit(1)).alias("n"))


@query("select c.language, count(*) n_calls, count(f.name) n_known from (select distinct call_id, called_name, language from calls) c left join (select distinct name from fn) f on f.name = c.called_name group by 1")
def a13_completeness(spark, sf):
    c = read_table(spark, sf, "calls").select("call_id", "called_name", "language").distinct()
    f = view(spark, sf, "fn").select(F.col("name").alias("called_name"), F.lit(1).alias("known")).distinct()
    # A name can hold a tenth of the calls, so they are counted per name before the names are looked up.
    per = c.groupBy("called_name", "language").agg(F.count(F.lit(1)).alias("n"))
    return per.join(f, "called_name", "left").groupBy("language").agg(F.sum("n").alias("n_calls"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("n_known"))


@query("select string_split(target_id, '.')[1] origin, count(*) n from edges where starts_with(target_id, 'ext:') group by 1")
def a14_external(spark, sf):
    return read_table(spark, sf, "edges").where(F.col("target_id").startswith("ext:")).groupBy(F.substring_index("target_id", ".", 1).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query("select mon, n, n - coalesce(lag(n) over (order by mon), 0) delta from (select strftime(indexed_at, '%Y-%m') mon, count(*) n from edges where indexed_at is not null group by 1)")
def a15_run_deltas(spark, sf):
    """Counts per month with the change to the month before: one row per month, so the single window is small."""
    from pyspark.sql import Window

    per = read_table(spark, sf, "edges").where("indexed_at is not null").groupBy(F.date_format(F.to_utc_timestamp("indexed_at", F.current_timezone()), "yyyy-MM").alias("mon")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("mon")
    return per.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)))


@query("""with q as (select vec_id query_id, embedding e from embeddings where vec_id % 100 = 0), d as (select query_id, vec_id, list_sum(list_transform(list_zip(embedding, e), lambda x: cast(x[1] as double) * cast(x[2] as double))) d from q, embeddings)
select query_id, vec_id, round(d, 3) score from (select *, row_number() over (partition by query_id order by round(d, 6) desc, vec_id) n from d) where n <= 10""")
def l07_vector_top(spark, sf):
    """The ten nearest vectors of every query vector (ids divisible by 100) by dot product, exact. The stated queries are
    taken in blocks of one matrix each, so a task holds a block and a batch; ten per query and batch go to the merge."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    e = read_table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0")
    blocks = max(1, -(-asked.count() // 20_000))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.col("vec_id") / 100, F.lit(blocks)) == b).collect()  # 20,000 vectors at most
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def near(batches, shared=shared):
            ids, queries = shared.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                mine, vectors = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(np.float64)
                for a in range(0, len(ids), 500):
                    score = queries[a : a + 500] @ vectors.T
                    order = np.lexsort((np.broadcast_to(mine, score.shape), -np.round(score, 6)), axis=1)[:, :10]
                    q = np.repeat(ids[a : a + 500], order.shape[1])
                    yield pd.DataFrame({"query_id": q, "vec_id": mine[order].ravel(), "d": np.take_along_axis(score, order, 1).ravel()})

        found = e.mapInPandas(near, "query_id long, vec_id long, d double")
        out = found if out is None else out.unionByName(found)
    first = Window.partitionBy("query_id").orderBy(F.desc(F.round("d", 6)), "vec_id")
    return out.withColumn("n", F.row_number().over(first)).where("n <= 10").select("query_id", "vec_id", F.round("d", 3).alias("score"))


@query("select t as \"text\", kind, id from (select t, kind, id, row_number() over (partition by t order by r, id) n from (select qualified_name t, 'Function' kind, id, 0 r from fn union all select qualified_name, 'Class', id, 1 from cls)) where n = 1")
def f02_by_qualified_name(spark, sf):
    """Node of each qualified name; functions before classes, of several the least id."""
    part = lambda v, kind, rank: view(spark, sf, v).select(F.col("qualified_name").alias("text"), F.lit(kind).alias("kind"), "id", F.lit(rank).alias("r"))
    every = part("fn", "Function", 0).unionByName(part("cls", "Class", 1))
    return every.groupBy("text").agg(F.min(F.struct("r", "id", "kind")).alias("m")).select("text", F.col("m.kind").alias("kind"), F.col("m.id").alias("id"))


@query("select c.call_id, f.id from (select distinct call_id, called_name, file_path from calls) c join fn f on f.name = c.called_name and f.file_path = c.file_path")
def f32_same_file(spark, sf):
    c = read_table(spark, sf, "calls").select("call_id", F.col("called_name").alias("name"), "file_path").distinct()
    return c.join(view(spark, sf, "fn").select("id", "name", "file_path"), ["name", "file_path"]).select("call_id", "id")


@query("select e.edge_id, 'source_id' as \"end\" from (select distinct edge_id, source_id, target_id from edges) e where source_id is not null and source_id not in (select id from function_nodes where id is not null union select id from class_nodes union select id from external_symbols) union all select e.edge_id, 'target_id' from (select distinct edge_id, source_id, target_id from edges) e where target_id is not null and target_id not in (select id from function_nodes where id is not null union select id from class_nodes union select id from external_symbols)")
def a10_orphan_edges(spark, sf):
    """Edge ends that no table knows, at any time."""
    ids = read_table(spark, sf, "function_nodes").select("id").union(read_table(spark, sf, "class_nodes").select("id")).union(read_table(spark, sf, "external_symbols").select("id")).distinct()
    e = read_table(spark, sf, "edges").select("edge_id", "source_id", "target_id").distinct()
    ends = e.select("edge_id", F.explode(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).alias("id")) for c in ("source_id", "target_id")])).alias("x")).select("edge_id", "x.end", "x.id")
    # An id can hold a third of the edges: the hot ones look their answer up in a broadcast of fewer than 200 rows.
    known = lookup_join(ends.where("id is not null"), ids.withColumn("known", F.lit(1)), ["id"])
    return known.where("known is null").select("edge_id", "end")


@query("select f.name, count(*) n from call_edge e join fn f on f.id = e.dst where e.confidence < 0.5 group by 1 order by n desc, f.name limit 20")
def a12_low_confidence_names(spark, sf):
    """The 20 names most often called with low confidence (a top-k report)."""
    e = view(spark, sf, "call_edge").where("confidence < 0.5").join(view(spark, sf, "fn").select(F.col("id").alias("dst"), "name"), "dst")
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20)


@query("select name, array_to_string(list_sort(list(id))[1:5], ',') shown, count(*) n from fn group by 1 having count(*) > 1")
def l06_candidates(spark, sf):
    """Names of several functions with the first five ids."""
    fn = view(spark, sf, "fn").select("name", "id")
    return L.first_five(fn, "name").join(fn.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name").where("n > 1").select("name", "shown", "n")


def queries() -> dict:
    return Q


def oracle_sql() -> dict:
    return SQL
