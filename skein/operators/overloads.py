"""Choice among overloads: argument types against parameter types, with a table of subtypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import bits
from skein.operators.lookup import lookup_join
from skein.operators.prefix_sum import number_rows
from skein.operators.traverse import ancestors
from skein.storage import Scratch, bounded, shuffle_partitions

# Boxed types of Java.
BOXES = (("int", "Integer"), ("long", "Long"), ("double", "Double"), ("float", "Float"), ("boolean", "Boolean"), ("char", "Character"), ("byte", "Byte"), ("short", "Short"))
GENERIC_DEPTH = 100


def type_closure(spark: SparkSession, subtypes: DataFrame, depth: int = 32, of: DataFrame | None = None, to: DataFrame | None = None) -> DataFrame:
    """child, parent, depth: least number of links from a type up to each of its supertypes (0: itself), over the rows
    child, parent of `subtypes`; each pair once. Cycles end where they meet a pair seen before.
    of, to: column type, the children and parents that are asked for (None: all); no other child is followed."""
    scratch = Scratch(spark)
    links = scratch.save(subtypes.where("child is not null and parent is not null and child <> parent").select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct())
    own = links.select(F.col("src").alias("child")).union(links.select("dst")).distinct()
    own = own if of is None else own.join(of.withColumnRenamed("type", "child"), "child", "left_semi")
    if bounded(links, bits.MOST):
        up = _levels_up(spark, links, depth, of, to, scratch)
    else:
        up = ancestors(links, depth, scratch, None if of is None else of.withColumnRenamed("type", "id"))
        up = up.select(F.col("id").alias("child"), F.col("ancestor").alias("parent"), F.col("level").alias("depth"))
    every = own.select("child", F.col("child").alias("parent"), F.lit(0).alias("depth")).unionByName(up)
    return every if to is None else every.join(to.withColumnRenamed("type", "parent"), "parent", "left_semi").select("child", "parent", "depth")


def _levels_up(spark: SparkSession, links: DataFrame, depth: int, of: DataFrame | None, to: DataFrame | None, scratch: Scratch) -> DataFrame:
    """child, parent, depth (1 on) by bit sets; no pair is shuffled."""
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    numbered = scratch.save(number_rows(ends, ["id"], "no", scratch))
    graph = bits.plain(bits.names_of(numbered), *bits.columns(bits.numbered_edges(links, numbered), "s", "d"))
    children = links.select(F.col("src").alias("id")).distinct()
    children = children if of is None else children.join(of.withColumnRenamed("type", "id"), "id", "left_semi")
    wanted = None if to is None else bits.columns(numbered.join(to.withColumnRenamed("type", "id"), "id", "left_semi"), "no")[0]
    sources = numbered.join(children, "id").select(F.col("no").cast("int").alias("no"), F.array("id").alias("owners")).repartition(shuffle_partitions(spark))
    return bits.reached(spark, graph, sources, depth, wanted).select(F.col("owner").alias("child"), F.col("id").alias("parent"), F.col("level").alias("depth"))


def asked_types(spark: SparkSession, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The types (column type) of arguments and of parameters among candidates, those of the first with all boxes."""
    each = lambda c: F.explode(F.array_distinct(c)).alias("type")
    boxes = spark.createDataFrame([(box,) for _, box in BOXES], "type string")
    of = candidates.select(each("arguments")).unionByName(boxes).distinct()
    return of, candidates.select(each(F.transform("params", lambda p: F.regexp_replace(p, r"\.\.\.$", "")))).distinct()


def compatible(spark: SparkSession, closure: DataFrame) -> DataFrame:
    """argument, parameter, depth of types that may stand for each other: supertypes, boxes both ways (depth 0), and the
    supertypes of a primitive's box. Equal types are left to the caller."""
    boxes = spark.createDataFrame(list(BOXES), "plain string, box string")
    up = closure.where("depth > 0").select(F.col("child").alias("argument"), F.col("parent").alias("parameter"), "depth")
    both = boxes.select(F.col("plain").alias("argument"), F.col("box").alias("parameter")).unionByName(boxes.select(F.col("box").alias("argument"), F.col("plain").alias("parameter"))).withColumn("depth", F.lit(0))
    boxed = boxes.join(up.withColumnRenamed("argument", "box"), "box").select(F.col("plain").alias("argument"), "parameter", "depth")
    return up.unionByName(both).unionByName(boxed).groupBy("argument", "parameter").agg(F.min("depth").alias("depth"))


def by_argument_types(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """The candidates (call_id, id, params: array of types, arguments: array of types, generics: array) that argument types
    leave, by exclusion.

    A candidate goes if the number of arguments does not fit or a known argument cannot stand for its parameter; an unknown
    one ('' or null), a generic parameter and a hint !T for another type than T never exclude. If none is left, all stay.
    Of several left the ones with least total depth stay (a generic parameter counts 100), of these those without
    variable arguments. types: argument, parameter, depth as in `compatible`. Only call and position are exploded, so a row
    is one argument of one candidate.
    """
    scratch = Scratch(candidates.sparkSession)
    types = scratch.save(types)
    n, m = F.size("params"), F.size("arguments")
    variadic = F.coalesce(F.try_element_at("params", F.lit(-1)), F.lit("")).endswith("...")
    base = candidates.select("call_id", "id", "params", "arguments", "generics", variadic.alias("variadic")).distinct().withColumn("fits", F.when(variadic, m >= n - 1).otherwise(m == n))
    known = F.filter(F.transform("arguments", lambda a, i: F.struct(i.alias("i"), a.alias("argument"))), lambda a: F.col("fits") & ~F.coalesce(a["argument"], F.lit("")).isin("", "null"))
    each = base.withColumn("at", F.explode_outer(known)).withColumn("argument", F.col("at.argument"))
    each = each.withColumn("parameter", F.regexp_replace(F.try_element_at("params", F.greatest(F.lit(1), F.least(F.col("at.i") + 1, n))), r"\.\.\.$", ""))
    each = each.withColumn("generic", F.array_contains("generics", F.col("parameter"))).select("call_id", "id", "fits", "variadic", "argument", "parameter", "generic")
    # Few types are named very often, so a shuffled lookup would be uneven.
    scored = each.join(F.broadcast(types), ["argument", "parameter"], "left") if bounded(types, 200_000) else lookup_join(each, types, ["argument", "parameter"])
    negative = F.col("argument").startswith("!")
    refused = F.when(F.col("generic"), False).when(negative, F.col("argument") == F.concat(F.lit("!"), "parameter")).otherwise((F.col("argument") != F.col("parameter")) & F.col("depth").isNull())
    cost = F.when(F.col("generic"), GENERIC_DEPTH).when(negative | (F.col("argument") == F.col("parameter")), 0).otherwise(F.coalesce("depth", F.lit(0)))
    per = scored.groupBy("call_id", "id", "fits", "variadic").agg(F.max(refused).alias("refused"), F.sum(F.when(F.col("argument").isNotNull(), cost)).alias("cost"))
    j = per.withColumn("ok", F.col("fits") & ~F.coalesce("refused", F.lit(False)))
    rank = F.struct((~F.col("ok")).alias("bad"), F.when(F.col("ok"), F.coalesce("cost", F.lit(0))).otherwise(0).alias("cost"), (F.col("ok") & F.col("variadic")).alias("variadic"))
    j = scratch.save(j.select("call_id", "id", rank.alias("rank")))
    best = j.groupBy("call_id").agg(F.min("rank").alias("best"))
    return j.join(best, "call_id").where("rank = best").select("call_id", "id")
