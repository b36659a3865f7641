"""Full hierarchies from parent-child links: cycles set apart, then heavy-path decomposition of the trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lookup import HOT_LEAST, HOT_SHARE, hot_keys, lookup_join
from skein.storage import Scratch, shuffle_partitions


@dataclass
class Hierarchy:
    """nodes: node, root_id, depth (-1 on a cycle, -2 below one, then root_id ''), head, pos (place in the chain), size
    (nodes of the subtree), first (place in the tree's heavy-first preorder; the subtree is first .. first + size - 1).
    chains: head, len, root_id, prefix (chain segments above it: array of head and last place), base (depth of its head).
    """

    nodes: DataFrame
    chains: DataFrame


def _hot(counts: DataFrame, key: str) -> list[tuple]:
    """Hot values of `key` from its count table, which holds one row per value."""
    return [(r[0],) for r in counts.where(F.col("n") > HOT_LEAST).orderBy(F.desc("n")).limit(HOT_SHARE).select(key).collect()]


def _doubling(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over child -> parent. Returns (node, size) of all nodes and (node, up) of those with no root.

    After round k, `up` is the ancestor 2^k links above (null beyond a root) and `size` counts the descendants less than
    2^k links below. A round in which no further node ran out of ancestors shows that the rest has no root.
    """
    parents = links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")
    state = scratch.save(
        links.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))
        .unionByName(parents.select("node", F.lit(None).cast("string").alias("up"), F.lit(1).cast("long").alias("size")))
    )
    open_before = -1
    while True:
        going = state.where(F.col("up").isNotNull())
        still = going.count()
        if still == open_before or still == 0:
            return state.select("node", "size"), going.select("node", "up")
        open_before = still
        below = scratch.save(going.groupBy("up").agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("n")))
        hot = _hot(below, "up")
        jump = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = lookup_join(going, jump, ["up"], "left", hot).select("node", F.col("next").alias("up"), "size")
        moved = moved.unionByName(state.where(F.col("up").isNull()).select("node", "up", "size"))
        grown = moved.join(below.select(F.col("up").alias("node"), "more"), "node", "left")
        after = scratch.save(grown.select("node", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        scratch.drop(state)
        scratch.drop(below)
        state = after


def _cycles(unrooted: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, depth) of nodes without a root: -1 on a cycle, -2 below one.

    `up` is a far ancestor. Doubling goes on until the set of far ancestors no longer shrinks; the step then permutes
    that set, so it is exactly the cycle nodes.
    """
    state = scratch.save(unrooted)
    size = -1
    while True:
        image = scratch.save(state.groupBy("up").agg(F.count(F.lit(1)).alias("n")))
        now = image.count()
        if now == size:
            on = image.select(F.col("up").alias("node"), F.lit(-1).alias("depth"))
            return state.select("node").join(on, "node", "left").select("node", F.coalesce("depth", F.lit(-2)).alias("depth"))
        size = now
        jump = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        after = scratch.save(lookup_join(state, jump, ["up"], "inner", _hot(image, "up")).select("node", F.col("next").alias("up")))
        scratch.drop(state)
        state = after


def _places(heavy: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, head, pos): pointer doubling along heavy links. Open pointers are distinct, as a node has one heavy child."""
    state = scratch.save(
        nodes.join(heavy, "node", "left").select("node", F.coalesce("parent", "node").alias("head"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("parent").isNull().alias("done"))
    )
    while True:
        going = state.where(~F.col("done"))
        if going.isEmpty():
            return state.select("node", "head", "pos")
        to = state.select(F.col("node").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"))
        moved = going.drop("done").join(to, "head").select("node", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done"))
        after = scratch.save(state.where("done").unionByName(moved))
        scratch.drop(state)
        state = after


def _before(df: DataFrame, order: list[str], weight: str, scratch: Scratch) -> DataFrame:
    """Adds `before`: the sum of `weight` over all rows earlier in the total order (range partitions, prefix-summed totals)."""
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *cols).sortWithinPartitions(*cols)
    ranged = ranged.withColumn("_part", F.spark_partition_id().cast("long")).withColumn("before", F.lit(0).cast("long"))

    def running(batches):
        total = 0
        for pdf in batches:
            sums = pdf[weight].cumsum()
            pdf["before"] = sums - pdf[weight] + total
            total += int(pdf[weight].sum())
            yield pdf

    saved = scratch.save(ranged.mapInPandas(running, ranged.schema))
    totals, offsets, sofar = saved.groupBy("_part").agg(F.sum(weight)).collect(), [], 0
    for part, n in sorted(map(tuple, totals)):
        offsets.append((part, sofar))
        sofar += int(n)
    table = df.sparkSession.createDataFrame(offsets, "_part long, _base long")  # one row per partition
    return saved.join(F.broadcast(table), "_part").withColumn("before", F.col("before") + F.col("_base")).drop("_part", "_base")


def build_hierarchy(links: DataFrame, scratch: Scratch | None = None) -> Hierarchy:
    """Hierarchy of (child, parent) links with one parent per child at most.

    A child with several parents keeps the least one; repeated links count once; rows with a null end are left out; a
    node that is its own parent is a cycle of one. No links give empty tables. Further columns are not read.

    Subtree sizes come from pointer doubling, so rounds grow with the logarithm of the depth. Each node's heaviest child
    continues its chain; any path meets at most log2(n) chains, hence chains are labelled top-down in as many rounds.
    """
    spark = links.sparkSession
    scratch = scratch or Scratch(spark)
    links = scratch.save(links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent")))
    sizes, rootless = _doubling(links, scratch)
    apart = scratch.save(_cycles(rootless, scratch)) if not rootless.isEmpty() else spark.createDataFrame([], "node string, depth int")
    rooted = scratch.save(sizes.join(apart.select("node"), "node", "left_anti"))

    up = links.select(F.col("child").alias("node"), "parent")
    tree = scratch.save(rooted.join(up, "node", "left"))  # node, size, parent (null: root)
    heaviest = scratch.save(tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "node")).alias("h"), F.count(F.lit(1)).alias("n")))
    heavy = heaviest.select(F.col("h.node").alias("node"), "parent")
    place = scratch.save(_places(heavy, tree.select("node"), scratch))

    # Chains: the head's parent is the node they hang on.
    lengths = place.groupBy("head").agg(F.max("pos").alias("last"))
    heads = tree.join(lengths.withColumnRenamed("head", "node"), "node")
    light = heads.where("parent is not null")
    siblings = _before(light.select("node", "parent", "size", F.negative("size").alias("key")), ["parent", "key", "node"], "size", scratch)
    first = siblings.groupBy("parent").agg(F.min("before").alias("least"))
    hung = place.join(heaviest.select(F.col("parent").alias("node"), F.col("h.size").alias("heavy")), "node").join(first.withColumnRenamed("parent", "node"), "node")
    hung = hung.select(F.col("node").alias("parent"), F.col("head").alias("on"), F.col("pos").alias("on_pos"), "heavy", "least")
    hot = _hot(heaviest, "parent")
    hanging = lookup_join(siblings, hung, ["parent"], "inner", hot).select(
        F.col("node").alias("head"), "on", "on_pos", (F.col("on_pos") + 1 + F.col("heavy") + F.col("before") - F.col("least")).alias("shift")
    )
    hanging = scratch.save(hanging)

    segment = "array<struct<head:string,last:bigint>>"
    level = scratch.save(heads.where("parent is null").select(F.col("node").alias("head"), F.col("node").alias("root_id"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("first"), F.array().cast(segment).alias("prefix")))
    levels = [level]
    hot_on = hot_keys(hanging, ["on"])
    while True:
        above = level.select(F.col("head").alias("on"), "root_id", "base", "first", "prefix")
        level = scratch.save(
            lookup_join(hanging, above, ["on"], "inner", hot_on).select(
                "head", "root_id", (F.col("base") + F.col("on_pos") + 1).alias("base"), (F.col("first") + F.col("shift")).alias("first"),
                F.concat("prefix", F.array(F.struct(F.col("on").alias("head"), F.col("on_pos").alias("last")))).cast(segment).alias("prefix"),
            )
        )
        if level.isEmpty():
            break
        levels.append(level)
    chains = levels[0]
    for more in levels[1:]:
        chains = chains.unionByName(more)
    chains = scratch.save(chains)
    labels = chains.select("head", "root_id", "base", F.col("first").alias("head_first"))
    nodes = lookup_join(place, labels, ["head"], "inner").join(rooted, "node").select(
        "node", "root_id", (F.col("base") + F.col("pos")).cast("int").alias("depth"), "head", "pos", "size", (F.col("head_first") + F.col("pos")).alias("first")
    )
    null_long = F.lit(None).cast("long")
    loose = apart.select("node", F.lit("").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.lit(None).cast("string").alias("head"), null_long.alias("pos"), null_long.alias("size"), null_long.alias("first"))
    return Hierarchy(scratch.save(nodes.unionByName(loose)), chains)


def full_paths(h: Hierarchy, separator: str = "/") -> DataFrame:
    """(node, path): root to node, joined from chain segments. A chain's ids are gathered once and cut per node.

    A gathered chain is as long as a path, which the result holds anyway.
    """
    ids = h.nodes.where("head is not null").groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]).alias("ids"))
    above = h.chains.select("head", F.posexplode("prefix").alias("i", "s")).select("head", "i", F.col("s.head").alias("on"), F.col("s.last").alias("last"))
    cut = lookup_join(above, ids.select(F.col("head").alias("on"), "ids"), ["on"], "inner").select("head", "i", F.expr("slice(ids, 1, cast(last as int) + 1)").alias("part"))
    prefix = cut.groupBy("head").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda s: s["part"])).alias("above"))
    chain = ids.join(prefix, "head", "left")
    return lookup_join(h.nodes.where("head is not null").select("node", "head", "pos"), chain, ["head"], "inner").select(
        "node", F.array_join(F.concat(F.coalesce("above", F.array().cast("array<string>")), F.expr("slice(ids, 1, cast(pos as int) + 1)")), separator).alias("path")
    )


def descendants_of(h: Hierarchy, wanted: DataFrame) -> DataFrame:
    """(node, descendant) for the nodes of `wanted` (column node): the preorder interval of each, within its tree.

    Intervals are split along 4096-wide blocks of the preorder, so that a tree that holds a third of all nodes is
    spread over many keys; the output itself has one row per descendant.
    """
    block = 4096
    asked = h.nodes.join(wanted.select("node").distinct(), "node", "left_semi").where("head is not null and size > 1")
    spans = asked.select("node", "root_id", (F.col("first") + 1).alias("a"), (F.col("first") + F.col("size") - 1).alias("b"))
    spans = spans.withColumn("block", F.explode(F.expr(f"sequence(a div {block}, b div {block})")))
    placed = h.nodes.where("head is not null").select(F.col("node").alias("descendant"), "root_id", "first", F.expr(f"first div {block}").alias("block"))
    return placed.join(spans, ["root_id", "block"]).where("first between a and b").select("node", "descendant")
