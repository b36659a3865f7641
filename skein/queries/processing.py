"""Queries of the general data-processing operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.balanced import balanced_key_counts, balanced_key_stats
from skein.operators.orphans import orphan_keys, orphan_rows
from skein.operators.snapshots import snapshot_changes
from skein.storage import month_index, read_table

# ---- 4: changes between snapshots


def canonical_path(p):
    return F.regexp_replace(F.regexp_replace(F.translate(p, "\\", "/"), "/+", "/"), r"^(\./)+|^/", "")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshot_changes(
        read_table(spark, sf_dir, "fingerprint_files"), ["source_project", "branch"], "last_indexed_at", "delivered_at", "files",
        key=canonical_path, content=lambda v: F.trim(v["content_hash"]), weak=["mod_time", "size"],
    )
    return out.withColumnRenamed("key", "path")


P4_SQL = r"""
with snaps as (
  select source_project, branch, last_indexed_at, arg_max(files, delivered_at) files
  from fingerprint_files where last_indexed_at is not null and files is not null group by all),
seq as (select source_project, branch, last_indexed_at, files,
  lead(last_indexed_at) over (partition by source_project, branch order by last_indexed_at) next_at,
  lag(last_indexed_at) over (partition by source_project, branch order by last_indexed_at) prev_at from snaps),
flat as (select source_project, branch, last_indexed_at, next_at, prev_at, unnest(map_entries(files)) e from seq),
ent as (select source_project, branch, last_indexed_at, next_at, prev_at,
  regexp_replace(regexp_replace(replace(e.key, '\', '/'), '/+', '/', 'g'), '^(\./)+|^/', '') path,
  nullif(lower(trim(e.value.content_hash)), '') h, e.value.mod_time m, e.value.size s from flat)
select b.source_project, b.branch, b.last_indexed_at, b.path,
  case when a.path is null then 'added' else 'changed' end change
from ent b left join ent a on a.source_project = b.source_project and a.branch = b.branch and a.last_indexed_at = b.prev_at and a.path = b.path
where b.prev_at is not null and (a.path is null or case when a.h is not null and b.h is not null then a.h <> b.h
  else a.m is distinct from b.m or a.s is distinct from b.s end)
union all
select a.source_project, a.branch, a.next_at, a.path, 'removed'
from ent a left join ent b on a.source_project = b.source_project and a.branch = b.branch and b.last_indexed_at = a.next_at and a.path = b.path
where a.next_at is not null and b.path is null
"""

# ---- 5: a few keys holding most rows


def p5_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = balanced_key_stats(read_table(spark, sf_dir, "edges"), "target_id", "source_id", "indexed_at")
    calls = balanced_key_stats(read_table(spark, sf_dir, "calls"), "called_name", "caller_name", "indexed_at")
    both = edges.withColumn("key_field", F.lit("edges.target_id")).unionByName(calls.withColumn("key_field", F.lit("calls.called_name")))
    return both.select("key_field", "key_value", "n_rows", "n_members", "first_at", "last_at")


P5_STATS_SQL = """
select 'edges.target_id' key_field, target_id key_value, count(*) n_rows, count(distinct source_id) n_members, min(indexed_at) first_at, max(indexed_at) last_at from edges group by target_id
union all
select 'calls.called_name', called_name, count(*), count(distinct caller_name), min(indexed_at), max(indexed_at) from calls group by called_name
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for table, column in (("edges", "target_id"), ("calls", "called_name")):
        df = read_table(spark, sf_dir, table)
        least = df.count()
        counts = balanced_key_counts(df, column).where(F.col("key_value").isNotNull() & (F.col("n_rows") * 50 >= least))
        found.append(counts.select(F.lit(f"{table}.{column}").alias("key_field"), "key_value"))
    return found[0].unionByName(found[1])


P5_SQL = """
select 'edges.target_id' key_field, target_id key_value from edges where target_id is not null group by target_id having count(*) * 50 >= (select count(*) from edges)
union all
select 'calls.called_name', called_name from calls where called_name is not null group by called_name having count(*) * 50 >= (select count(*) from calls)
"""

# ---- 7: references to records that do not exist


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, calls = read_table(spark, sf_dir, "edges"), read_table(spark, sf_dir, "calls")
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_column"), F.col(c).alias("key")) for c in ("source_id", "target_id")]))
    a = edges.select(F.lit("edges").alias("ref_table"), F.col("edge_id").alias("row_id"), month_index(F.col("indexed_at")).alias("month"), F.lit("id").alias("space"), ends.alias("e")).select("ref_table", "e.ref_column", "row_id", "space", "e.key", "month")
    b = calls.where("is_pre_resolved").select(F.lit("calls").alias("ref_table"), F.lit("called_name").alias("ref_column"), F.col("call_id").alias("row_id"), F.lit("qn").alias("space"), F.col("called_name").alias("key"), month_index(F.col("indexed_at")).alias("month"))
    return a.unionByName(b)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, classes, external = (read_table(spark, sf_dir, t) for t in ("function_nodes", "class_nodes", "external_symbols"))
    since, until = month_index(F.col("indexed_at")).alias("since"), month_index(F.col("deleted_at")).alias("until")
    never = F.lit(None).cast("int").alias("until")
    spaces = F.explode(F.array(F.struct(F.lit("id").alias("space"), F.col("id").alias("key")), F.struct(F.lit("qn").alias("space"), F.col("qualified_name").alias("key")))).alias("s")
    parts = [
        functions.select(spaces, since, until).select("s.*", "since", "until"),
        classes.select(F.lit("id").alias("space"), F.col("id").alias("key"), since, never),
        external.select(spaces, F.lit(0).alias("since"), never).select("s.*", "since", "until"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = references(spark, sf_dir)
    return refs, orphan_keys(refs.withColumn("n", F.lit(1)), records(spark, sf_dir), ["space"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, orphans = _orphans(spark, sf_dir)
    return orphan_rows(refs, orphans, ["space"]).select("ref_table", "ref_column", "row_id", "reason").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month; a repeated row counts once."""
    refs, orphans = _orphans(spark, sf_dir)
    found = orphan_rows(refs, orphans, ["space"]).select("ref_table", "ref_column", "row_id", "month", "reason").distinct()
    period = F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"))
    return found.groupBy("ref_table", "ref_column", period.alias("period"), "reason").agg(F.count(F.lit(1)).alias("n_refs"))


_P7_CTE = """
with refs as (
  select 'edges' ref_table, 'source_id' ref_column, edge_id row_id, 'id' space, source_id key, indexed_at from edges
  union all select 'edges', 'target_id', edge_id, 'id', target_id, indexed_at from edges
  union all select 'calls', 'called_name', call_id, 'qn', called_name, indexed_at from calls where is_pre_resolved),
r as (select distinct ref_table, ref_column, row_id, space, key, date_trunc('month', indexed_at at time zone 'UTC') mon from refs where key is not null and indexed_at is not null),
recs as (
  select 'id' space, id key, indexed_at at time zone 'UTC' i, deleted_at at time zone 'UTC' d from function_nodes
  union all select 'qn', qualified_name, indexed_at at time zone 'UTC', deleted_at at time zone 'UTC' from function_nodes
  union all select 'id', id, indexed_at at time zone 'UTC', null from class_nodes
  union all select 'id', id, timestamp '1900-01-01', null from external_symbols
  union all select 'qn', qualified_name, timestamp '1900-01-01', null from external_symbols),
k as (select distinct space, key, mon from r),
s as (select k.space, k.key, k.mon, count(recs.key) n, coalesce(bool_or(i < mon + interval 1 month and (d is null or d >= mon + interval 1 month)), false) live,
   coalesce(bool_and(i >= mon + interval 1 month), false) late
  from k left join recs on recs.space = k.space and recs.key = k.key group by all),
f as (select r.*, case when n = 0 then 'missing' when late then 'late' else 'deleted' end reason
  from r join s on r.space = s.space and r.key = s.key and r.mon = s.mon where not live)
"""
P7_SQL = _P7_CTE + "select distinct ref_table, ref_column, row_id, reason from f"
P7_REPORT_SQL = _P7_CTE + "select ref_table, ref_column, strftime(mon, '%Y-%m') period, reason, count(distinct row_id) n_refs from f group by all"


def queries() -> dict:
    return {"p4_found": p4_found, "p5_found": p5_found, "p5_key_stats": p5_key_stats, "p7_found": p7_found, "p7_report": p7_report}


def oracle_sql() -> dict:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL, "p5_key_stats": P5_STATS_SQL, "p7_found": P7_SQL, "p7_report": P7_REPORT_SQL}
