"""Filters over sub-graphs: core, dry, compact, declared type, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import Scratch

# Names of logging methods that the dry view leaves out.
LOG_NAMES = ("info", "warn", "error", "log", "debug", "trace")


def core(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without accessors and external nodes (file path null, '' or [external]), and without their edges. A root is no
    node, so edges at a root stay if their other end does."""
    keep = ~F.col("is_getter") & ~F.col("is_setter") & ~F.coalesce("file_path", F.lit("")).isin("", "[external]")
    gone = nodes.where(~keep).select("root", "id")
    return nodes.where(keep), _without(edges, gone)


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["root", end], "left_anti")
    return edges


def dry(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Without log calls, exception constructors and base methods whose override for the declared type is present; then
    callees left without any caller go too, until nothing changes. Nodes on a cycle keep each other."""
    name = F.lower("name")
    noise = nodes.where(F.col("name").isin(*LOG_NAMES) | (F.col("is_constructor") & (name.contains("exception") | name.contains("error")))).select("root", "id")
    declared = edges.where(F.coalesce("declared_type", F.lit("")) != "").select("root", F.col("dst").alias("id"), "declared_type").distinct()
    own = nodes.select("root", "id", "qualified_name")
    base = declared.join(own, ["root", "id"]).where(~F.expr("startswith(qualified_name, declared_type || '.')"))
    targets = edges.where("kind = 'DISPATCHES'").select("root", F.col("src").alias("id"), F.col("dst").alias("o")).join(own.select("root", F.col("id").alias("o"), F.col("qualified_name").alias("oq")), ["root", "o"])
    covered = base.join(targets, ["root", "id"]).where(F.expr("startswith(oq, declared_type || '.')")).select("root", "id")
    gone = scratch.save(noise.unionByName(covered).distinct())
    nodes = scratch.save(nodes.join(gone, ["root", "id"], "left_anti"))
    edges = scratch.save(_without(edges, gone))
    while True:
        called = edges.select("root", F.col("dst").alias("id")).distinct()
        orphan = scratch.save(nodes.join(called, ["root", "id"], "left_anti").select("root", "id"))
        if orphan.isEmpty():
            return nodes, edges
        nodes = scratch.save(nodes.join(orphan, ["root", "id"], "left_anti"))
        edges = scratch.save(_without(edges, orphan))


def compact(edges: DataFrame) -> DataFrame:
    """One edge per (root, src, dst, kind): its distinct lines in order, and the greatest confidence."""
    return edges.groupBy("root", "src", "dst", "kind").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.max("confidence").alias("confidence"))


def declared_type_only(edges: DataFrame, qualified_class: str) -> DataFrame:
    """Edges of a reverse chain whose call of the root declares the class, and those above the kept callers, level by level
    up to the chain's last."""
    first = edges.where((F.col("level") == 1) & (F.col("dst") == F.col("root")) & (F.col("declared_type") == qualified_class))
    kept, frontier = first, first.select("root", F.col("src").alias("dst")).distinct()
    last = edges.agg(F.max("level")).first()[0] or 1
    for level in range(2, last + 1):
        more = edges.where(F.col("level") == level).join(frontier, ["root", "dst"], "left_semi")
        kept, frontier = kept.unionByName(more), more.select("root", F.col("src").alias("dst")).distinct()
    return kept


def chains(edges: DataFrame) -> DataFrame:
    """Calls of one chain expression, assembled: root, src, chain_id, steps (callees from the innermost call outwards)."""
    linked = edges.where((F.col("kind") == "CALLS") & (F.col("chain_id") > 0))
    ordered = F.array_sort(F.collect_set(F.struct("chain_depth", "dst")))
    return linked.groupBy("root", "src", "chain_id").agg(F.array_join(F.transform(ordered, lambda s: s["dst"]), ">").alias("steps"), F.countDistinct("chain_depth", "dst").alias("n_steps"))
