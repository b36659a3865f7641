"""Bounded traversal of call graphs, many roots at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import bits
from skein.operators.prefix_sum import number_rows
from skein.storage import Scratch, bounded, shuffle_partitions


class Subgraph(NamedTuple):
    """nodes: root, id, level. edges: root, src, dst, kind, level, line, confidence, declared_type, chain_id,
    chain_depth. frontier: root, id of the last level."""

    nodes: DataFrame
    edges: DataFrame
    frontier: DataFrame


def call_chain(functions: DataFrame, calls: DataFrame, dispatches: DataFrame, roots: DataFrame, depth: int = 3, reverse: bool = False, min_confidence: float = 0.0, scratch: Scratch | None = None) -> Subgraph:
    """Call chains of `roots` (column id), level by level.

    A level takes the frontier's CALLS edges with confidence null or >= min_confidence; all of them are kept, new
    neighbours are not in the visited set. Then the DISPATCHES edges of the new neighbours follow, narrowed to targets
    below a type their callers declared, unless the neighbour lies below such a type itself; their new targets join the
    next frontier. Edges keep their true direction for reverse chains. Levels are written, so lineage stays short; a
    level without new nodes ends the loop.
    """
    scratch = scratch or Scratch(functions.sparkSession)
    near, far = ("dst", "src") if reverse else ("src", "dst")
    sure = lambda e: e.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    # Read at every level, so worked out once.
    names = scratch.save(functions.select("id", "qualified_name"))
    calls = scratch.save(sure(calls).select("src", "dst", "line", "confidence", "declared_type", "chain_id", "chain_depth"))
    dispatches = scratch.save(sure(dispatches).select("src", "dst", "confidence"))
    empty_types = {"line": "int", "declared_type": "string", "chain_id": "int", "chain_depth": "int"}
    frontier = roots.select(F.col("id").alias("root"), "id").distinct()
    visited = scratch.save(frontier)
    all_nodes, all_edges = [], []
    frontier = visited
    for level in range(1, depth + 1):
        step = scratch.save(calls.join(frontier.select("root", F.col("id").alias(near)), near).select("root", "src", "dst", F.lit("CALLS").alias("kind"), F.lit(level).alias("level"), "line", "confidence", "declared_type", "chain_id", "chain_depth"))
        new = step.select("root", F.col(far).alias("id")).distinct().join(visited, ["root", "id"], "left_anti")
        new = scratch.save(new)
        types = step.where(F.coalesce("declared_type", F.lit("")) != "").select("root", F.col(far).alias("id"), F.concat("declared_type", F.lit(".")).alias("prefix")).distinct().join(names, "id")
        types = types.groupBy("root", "id").agg(F.collect_set("prefix").alias("prefixes"), F.max(F.expr("startswith(qualified_name, prefix)")).alias("own"))
        sent = dispatches.join(new.select("root", F.col("id").alias(near)), near).select("root", "src", "dst", "confidence", F.col(near).alias("id"), F.col(far).alias("other"))
        sent = sent.join(types, ["root", "id"], "left").join(names.select(F.col("id").alias("other"), F.col("qualified_name").alias("other_name")), "other")
        sent = sent.where(F.col("prefixes").isNull() | F.col("own") | F.exists("prefixes", lambda p: F.col("other_name").startswith(p)))
        sent = scratch.save(sent.select("root", "src", "dst", F.lit("DISPATCHES").alias("kind"), F.lit(level).alias("level"), F.lit(None).cast("int").alias("line"), "confidence", *[F.lit(None).cast(t).alias(n) for n, t in empty_types.items() if n != "line"]))
        more = scratch.save(sent.select("root", F.col(far).alias("id")).distinct().join(visited.unionByName(new), ["root", "id"], "left_anti"))
        frontier = new.unionByName(more)  # both written, as the visited nodes of each level are
        all_nodes.append(frontier.withColumn("level", F.lit(level)))
        all_edges += [step, sent]
        if level < depth:
            if frontier.isEmpty():
                break
            visited = visited.unionByName(frontier)
    nodes, edges = all_nodes[0], all_edges[0]
    for x in all_nodes[1:]:
        nodes = nodes.unionByName(x)
    for x in all_edges[1:]:
        edges = edges.unionByName(x)
    return Subgraph(nodes, edges, frontier)


def owned_chain(functions: DataFrame, calls: DataFrame, dispatches: DataFrame, owned: DataFrame, depth: int, min_confidence: float = 0.0, scratch: Scratch | None = None) -> DataFrame:
    """owner, id, level: for each row owner, id of `owned` the nodes of the call chain from id, as `call_chain` gives them,
    without their edges. A root is followed once, however many owners it has. Graphs of up to `bits.MOST` rows a table are
    sent to the workers, where all roots of a task go at once as bits; larger ones go through `call_chain`."""
    spark = functions.sparkSession
    scratch = scratch or Scratch(spark)
    owned = scratch.save(owned.select("owner", "id").distinct())
    names = scratch.save(functions.select("id", "qualified_name"))
    sure = lambda e: e.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    edges = scratch.save(sure(calls).select("src", "dst", F.nullif("declared_type", F.lit("")).alias("type")).distinct())
    sent = scratch.save(sure(dispatches).select("src", "dst").distinct().join(names.select(F.col("id").alias("dst")), "dst", "left_semi"))
    target = F.col("id").alias("dst")
    typed = edges.where("type is not null").select("dst", "type").distinct().join(sent.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(names.select(target), "dst", "left_semi")
    groups = scratch.save(number_rows(typed, ["dst", "type"], "group", scratch))
    both = groups.join(names.select(target, F.col("qualified_name").alias("own")), "dst").withColumnRenamed("dst", "src").join(sent, "src").join(names.select(target, F.col("qualified_name").alias("other")), "dst")
    fits = scratch.save(both.where("startswith(own, type || '.') or startswith(other, type || '.')").select("src", "dst", "group"))
    if not all(bounded(t, bits.MOST) for t in (names, edges, sent, fits)):
        sub = call_chain(functions, calls, dispatches, owned.select("id").distinct(), depth, False, min_confidence, scratch)
        return owned.withColumnRenamed("id", "root").join(sub.nodes, "root").select("owner", "id", "level")
    ends = [t.select(F.col(c).alias("id")) for t in (edges, sent) for c in ("src", "dst")] + [owned.select("id")]
    numbered = scratch.save(number_rows(reduce(DataFrame.union, ends).distinct(), ["id"], "no", scratch))
    at = lambda t: bits.numbered_edges(t, numbered)
    called = at(edges.join(groups, ["dst", "type"], "left").select("src", "dst", F.coalesce("group", F.lit(-1)).alias("group")))
    graph = bits.with_dispatches(bits.names_of(numbered), bits.columns(called, "s", "d", "group"), bits.columns(at(sent), "s", "d"), bits.columns(at(fits), "s", "d", "group"))
    roots = owned.groupBy("id").agg(F.array_sort(F.collect_list("owner")).alias("owners")).join(numbered, "id")
    return bits.reached(spark, graph, roots.select(F.col("no").cast("int").alias("no"), "owners").repartition(shuffle_partitions(spark)), depth)


def truncated(sub: Subgraph, functions: DataFrame, calls: DataFrame, dispatches: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """root, id, text: how many edges of the last level lead to nodes outside the chain."""
    last = sub.frontier
    known = sub.nodes.select("root", F.col("id").alias("dst")).unionByName(sub.nodes.select("root", F.col("root").alias("dst"))).distinct()
    out = calls.select("src", "dst", "confidence").unionByName(dispatches.select("src", "dst", "confidence")).where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    rest = out.join(last.select("root", F.col("id").alias("src")), "src").join(known, ["root", "dst"], "left_anti").groupBy("root", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = rest.join(functions.select("id", "qualified_name"), "id")
    return named.select("root", "id", F.format_string("%s (%d direct callees not expanded)", "qualified_name", "n").alias("text"))


def reachable_sizes(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, level of nodes of an acyclic part of a graph by repeated peeling (Kahn): a node's level is the longest path to
    it; nodes on or behind cycles get level null."""
    left = scratch.save(links.select("src", "dst").distinct())
    nodes = scratch.save(left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct())
    placed, level = [], 0
    while True:
        free = scratch.save(nodes.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            placed.append(nodes.withColumn("level", F.lit(None).cast("int")))
            break
        placed.append(free.withColumn("level", F.lit(level)))
        nodes = scratch.save(nodes.join(free, "id", "left_anti"))
        left = scratch.save(left.join(free.withColumnRenamed("id", "src"), "src", "left_anti"))
        level += 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def ancestors(extends: DataFrame, depth: int, scratch: Scratch, of: DataFrame | None = None) -> DataFrame:
    """id, ancestor, level up to `depth` links above, nearest first; each pair once, cycles end at a pair seen before.
    of: column id, the nodes whose ancestors are asked for (None: all)."""
    first = extends.select(F.col("src").alias("id"), F.col("dst").alias("ancestor")).distinct()
    first = first if of is None else first.join(of, "id", "left_semi")
    step = scratch.save(first.withColumn("level", F.lit(1)))
    found, frontier = step, step
    for level in range(2, depth + 1):
        up = extends.select(F.col("src").alias("ancestor"), F.col("dst").alias("next")).distinct()
        new = frontier.join(up, "ancestor").select("id", F.col("next").alias("ancestor")).distinct().where("id <> ancestor").join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        frontier = scratch.save(new.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        found = scratch.save(found.unionByName(frontier))
    return found
