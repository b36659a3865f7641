"""Queries over class hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hierarchy import build_hierarchy, descendants_of, full_paths
from skein.operators.lookup import lookup_join
from skein.storage import Scratch, read_table


def short_name(written):
    """Short name of a type as written in source: without type arguments, qualifiers, pointers and spaces."""
    return F.regexp_extract(F.trim(F.regexp_replace(written, r"[<\[(][\s\S]*$", "")), r"([A-Za-z0-9_$]+)\s*$", 1)


def class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) class ids from heritage rows (extends, embedding) and EXTENDS edges between known classes."""
    classes = read_table(spark, sf_dir, "class_nodes").where("id is not null").select("id", "name", F.col("qualified_name").alias("qn"), "file_path", F.col("source_project").alias("project")).distinct()
    heritage = read_table(spark, sf_dir, "heritage").where(F.col("kind").isin("extends", "embedding")).select(
        F.trim("child_name").alias("child_name"), F.nullif(F.col("child_qualified"), F.lit("")).alias("cq"), short_name(F.col("parent_name")).alias("parent_name"), F.nullif(F.col("parent_qualified"), F.lit("")).alias("pq"), "file_path"
    ).distinct()
    by_qn = classes.where("qn is not null").groupBy("qn").agg(F.min(F.struct("id", "project")).alias("c")).select("qn", "c.id", "c.project")
    in_file = classes.groupBy("name", "file_path").agg(F.min(F.struct("id", "project")).alias("c")).select("name", "file_path", "c.id", "c.project")
    in_project = classes.groupBy("name", "project").agg(F.min("id").alias("id"))
    known = lookup_join(heritage.where("cq is not null"), by_qn.select(F.col("qn").alias("cq"), F.col("id").alias("child"), "project"), ["cq"], "inner")
    named = lookup_join(heritage.where("cq is null"), in_file.select(F.col("name").alias("child_name"), "file_path", F.col("id").alias("child"), "project"), ["child_name", "file_path"], "inner")
    child = known.unionByName(named).select("child", "project", "parent_name", "pq")
    a = lookup_join(child.where("pq is not null"), by_qn.select(F.col("qn").alias("pq"), F.col("id").alias("parent")), ["pq"], "inner")
    b = lookup_join(child.where("pq is null"), in_project.select(F.col("name").alias("parent_name"), "project", F.col("id").alias("parent")), ["parent_name", "project"], "inner")
    edges = read_table(spark, sf_dir, "edges").where("kind = 'EXTENDS'").select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")).distinct()
    ids = classes.select("id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return a.select("child", "parent").unionByName(b.select("child", "parent")).unionByName(edges.select("child", "parent")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = build_hierarchy(class_links(spark, sf_dir)).nodes
    return nodes.select(F.col("node").alias("class_id"), "root_id", "depth")


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and number of descendants of each class of a tree; `p2_classes` has the classes on and below cycles too."""
    h = build_hierarchy(class_links(spark, sf_dir), Scratch(spark))
    out = h.nodes.where("head is not null").join(full_paths(h), "node")
    return out.select(F.col("node").alias("class_id"), "root_id", "depth", "path", (F.col("size") - 1).alias("n_descendants"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked class with depth -1 on a cycle and -2 below one (root_id '', no path), else its path and its interval:
    the descendants are the classes of the same root_id with `first` + 1 .. `first` + n_descendants as their `first`."""
    h = build_hierarchy(class_links(spark, sf_dir), Scratch(spark))
    out = h.nodes.join(full_paths(h), "node", "left")
    return out.select(F.col("node").alias("class_id"), "root_id", "depth", "path", "first", (F.col("size") - 1).alias("n_descendants"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every class of a tree, one row each."""
    h = build_hierarchy(class_links(spark, sf_dir), Scratch(spark))
    return descendants_of(h, h.nodes).select(F.col("node").alias("class_id"), F.col("descendant").alias("descendant_id"))


_LINKS = r"""
cls as (select distinct id, name, qualified_name qn, file_path, source_project project from class_nodes where id is not null),
h as (select distinct trim(child_name) child_name, nullif(child_qualified, '') cq, nullif(parent_qualified, '') pq, file_path,
  regexp_extract(trim(regexp_replace(parent_name, '[<\[(].*$', '')), '([A-Za-z0-9_$]+)\s*$', 1) short
  from heritage where kind in ('extends', 'embedding')),
hc as (select a.id child, a.project, pq, short from h join cls a on h.cq = a.qn
  union select b.id, b.project, pq, short from h join cls b on h.cq is null and b.name = h.child_name and b.file_path = h.file_path),
links as (select child, a.id parent from hc join cls a on hc.pq = a.qn
  union select child, b.id from hc join cls b on hc.pq is null and b.name = hc.short and b.project = hc.project
  union select source_id, target_id from edges where kind = 'EXTENDS' and source_id in (select id from cls) and target_id in (select id from cls)),
one as (select child, min(parent) parent from links group by child),
"""
P2_SQL = (
    "with recursive "
    + _LINKS
    + """
roots as (select distinct parent id from one where parent not in (select child from one)),
down as (select id, id root_id, 0 depth from roots union all select o.child, d.root_id, d.depth + 1 from down d join one o on o.parent = d.id),
loose as (select child id from one where child not in (select id from down)),
step as (select id origin, o.parent here from loose join one o on o.child = id union select s.origin, o.parent from step s join one o on o.child = s.here)
select id class_id, root_id, cast(depth as integer) depth from down
union all select id, '', case when exists (select 1 from step s where s.origin = id and s.here = id) then -1 else -2 end from loose
"""
)
P2_HIERARCHY_SQL = (
    "with recursive "
    + _LINKS
    + """
roots as (select distinct parent id from one where parent not in (select child from one)),
down as (select id, id root_id, 0 depth, id path, [id] ids from roots
  union all select o.child, d.root_id, d.depth + 1, d.path || '/' || o.child, list_append(d.ids, o.child) from down d join one o on o.parent = d.id),
n as (select unnest(ids) id, count(*) - 1 n_descendants from down group by 1)
select d.id class_id, root_id, cast(depth as integer) depth, path, n_descendants from down d join n on n.id = d.id
"""
)


def queries() -> dict:
    return {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_classes": p2_classes, "p2_descendants": p2_descendants}


def oracle_sql() -> dict:
    return {"p2_found": P2_SQL, "p2_hierarchy": P2_HIERARCHY_SQL}
