"""Calls resolved over their receivers: its type, the methods of that type and of its ancestors, external symbols.

Every strategy is a join that yields (call_id, id, strategy, rank); the best rank of a call stays. Inputs are node and call
tables as in `skein.lens`: methods (id, name, owner: class id, file_path, parsed: parameters), calls (call_id, called_name,
caller_name, file_path, receiver, arg_count), classes (id, name, qualified_name, file_path, source_project, fields).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators import lookups as L
from skein.storage import Scratch

# Confidence by strategy.
CONFIDENCE = {"super_call": 0.95, "type_exact": 0.95, "hierarchy": 0.95, "type_same_file": 0.85, "arg_count": 0.85, "same_package": 0.85, "external": 0.70}
MULTI = 0.65  # divided by the number of candidates that are left


def caller_classes(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """call_id, class_id: the class in which the caller is defined; of several the least id."""
    owner = S.owner_name(F.col("caller_name")).alias("qualified_name")
    hit = calls.where("caller_name is not null").select("call_id", owner).distinct().join(classes.select(F.col("id").alias("class_id"), "qualified_name"), "qualified_name")
    return hit.groupBy("call_id").agg(F.min("class_id").alias("class_id"))


def receiver_types(calls: DataFrame, functions: DataFrame, classes: DataFrame, inherited: DataFrame) -> DataFrame:
    """call_id, class_id, source: the class that a call's receiver has.

    this and self stand for the caller's class; `this.x`, `self.x` and a bare name for the type of the caller's parameter
    (bare names only), of a field of the caller's class, or of an inherited one; a capitalised bare name for the class of that
    name. Types are looked up by simple name (of several classes the one in the file, then in the project, then the least
    id). The first source that gives a class counts. Receivers with calls or longer paths have none here. inherited:
    class_id, ancestor, level.
    """
    c = calls.where("receiver <> ''").select("call_id", "caller_name", "file_path", "receiver").distinct()
    own = caller_classes(c, classes).withColumnRenamed("class_id", "own")
    c = c.join(own, "call_id", "left").withColumn("var", F.regexp_extract("receiver", r"^(?:(?:this|self)\.)?([A-Za-z_$][\w$]*)$", 1)).withColumn("bare", ~F.col("receiver").contains("."))
    itself = c.where(F.col("receiver").isin("this", "self") & F.col("own").isNotNull()).select("call_id", F.col("own").alias("class_id"), F.lit(0).alias("rank"))
    named = c.where((F.col("var") != "") & ~F.col("receiver").isin("this", "self", "super"))
    params = functions.select(F.col("qualified_name").alias("caller_name"), F.explode("parsed").alias("p")).select("caller_name", F.col("p.name").alias("var"), F.col("p.type").alias("type")).distinct()
    fields = L.fields_of(classes).select("class_id", F.col("field").alias("var"), "type").distinct()
    up = inherited.join(fields.withColumnRenamed("class_id", "ancestor"), "ancestor").groupBy("class_id", "var").agg(F.min(F.struct("level", "type")).alias("m")).select("class_id", "var", F.col("m.type").alias("type"))
    typed = (
        named.where("bare").join(params, ["caller_name", "var"]).select("call_id", "file_path", "type", F.lit(1).alias("rank"))
        .unionByName(named.join(fields.withColumnRenamed("class_id", "own"), ["own", "var"]).select("call_id", "file_path", "type", F.lit(2).alias("rank")))
        .unionByName(named.join(up.withColumnRenamed("class_id", "own"), ["own", "var"]).select("call_id", "file_path", "type", F.lit(3).alias("rank")))
        .unionByName(named.where(F.col("bare") & F.col("var").rlike("^[A-Z]")).select("call_id", "file_path", F.col("var").alias("type"), F.lit(4).alias("rank")))
    )
    simple = F.substring_index(F.regexp_replace(F.regexp_replace("type", r"^[*&\[\]]+", ""), r"[<\[?].*$", ""), ".", -1)
    k = classes.select(F.col("id").alias("class_id"), F.col("name").alias("simple"), F.col("file_path").alias("class_file"), "source_project")
    hit = typed.withColumn("simple", simple).join(k, "simple")
    near = F.when(F.col("class_file") == F.col("file_path"), 0).when(F.substring_index("file_path", "/", 1) == F.col("source_project"), 1).otherwise(2)
    every = itself.select("call_id", F.struct("rank", F.lit(0).alias("near"), "class_id").alias("m")).unionByName(hit.select("call_id", F.struct("rank", near.alias("near"), "class_id").alias("m")))
    source = F.create_map(*[x for i, n in enumerate(("self", "parameter", "field", "inherited_field", "class_name")) for x in (F.lit(i), F.lit(n))])
    return every.groupBy("call_id").agg(F.min("m").alias("m")).select("call_id", F.col("m.class_id").alias("class_id"), source[F.col("m.rank")].alias("source"))


def methods_of_types(calls: DataFrame, types: DataFrame, methods: DataFrame, inherited: DataFrame) -> DataFrame:
    """call_id, id, level: methods of the called name in the receiver's class (level 0) or else in its nearest ancestor."""
    c = calls.select("call_id", F.col("called_name").alias("name")).distinct().join(types.select("call_id", "class_id"), "call_id")
    m = methods.select("id", "name", F.col("owner"))
    own = c.join(m.withColumnRenamed("owner", "class_id"), ["class_id", "name"]).select("call_id", "id", F.lit(0).alias("level"))
    up = c.join(inherited, "class_id").join(m.withColumnRenamed("owner", "ancestor"), ["ancestor", "name"]).select("call_id", "id", "level")
    every = own.unionByName(up)
    return every.join(every.groupBy("call_id").agg(F.min("level").alias("level")), ["call_id", "level"]).select("call_id", "id", "level").distinct()


def super_calls(calls: DataFrame, methods: DataFrame, classes: DataFrame, inherited: DataFrame) -> DataFrame:
    """call_id, id: the method of the called name in the caller's nearest ancestor, for receivers super and super()."""
    c = calls.where(F.col("receiver").rlike(r"^super(\(.*\))?$"))
    own = caller_classes(c, classes)
    named = c.select("call_id", F.col("called_name").alias("name")).distinct().join(own, "call_id").join(inherited, "class_id")
    hit = named.join(methods.select("id", "name", F.col("owner").alias("ancestor")), ["ancestor", "name"])
    return hit.groupBy("call_id").agg(F.min(F.struct("level", "id")).alias("m")).select("call_id", F.col("m.id").alias("id"))


def disambiguate(calls: DataFrame, candidates: DataFrame, functions: DataFrame, exact: str = "type_exact") -> DataFrame:
    """Edges (call_id, target_id, resolved_by, confidence, candidates) out of candidates (call_id, id): one alone is exact; of
    several the only one in the caller's file, then the only one that takes the number of arguments; else all that take it
    (or all), each with MULTI / their number. Work is per (call, candidate); nothing is gathered per name."""
    c = calls.select("call_id", F.col("file_path").alias("call_file"), "arg_count").groupBy("call_id").agg(F.min("call_file").alias("call_file"), F.min("arg_count").alias("arg_count"))
    j = candidates.select("call_id", "id").distinct().join(functions.select("id", "file_path", "parsed"), "id").join(c, "call_id")
    j = j.withColumn("near", F.col("file_path") == F.col("call_file")).withColumn("fits", F.coalesce(S.accepts_arguments(F.col("parsed"), F.col("arg_count")), F.lit(False)))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    n = j.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), one("near").alias("n_near"), one("fits").alias("n_fits"))
    j = j.join(n, "call_id")
    how = F.when(F.col("n") == 1, exact).when(F.col("n_near") == 1, "type_same_file").when(F.col("n_fits") == 1, "arg_count").otherwise("type_multi")
    keep = F.expr("case how when 'type_same_file' then near when 'arg_count' then fits when 'type_multi' then n_fits = 0 or fits else true end")
    j = j.withColumn("how", how).where(keep)
    left = F.when(F.col("n_fits") > 0, F.col("n_fits")).otherwise(F.col("n"))
    value = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return j.select("call_id", F.col("id").alias("target_id"), F.col("how").alias("resolved_by"), F.when(F.col("how") == "type_multi", MULTI / left).otherwise(value[F.col("how")]).alias("confidence"), F.when(F.col("how") == "type_multi", left).otherwise(1).alias("candidates"))


def same_package(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """call_id, id: functions of the called name in the package of the caller (its qualified name up to the class's)."""
    package = lambda c: F.regexp_replace(c, r"\.[^.]*\.[^.]*$", "")
    c = calls.where("caller_name is not null").select("call_id", F.col("called_name").alias("name"), package(F.col("caller_name")).alias("package")).distinct()
    return c.join(functions.select("id", "name", package(F.col("qualified_name")).alias("package")), ["name", "package"]).select("call_id", "id").distinct()


def external_targets(calls: DataFrame, external: DataFrame, functions: DataFrame) -> DataFrame:
    """call_id, target_id: for calls whose name no function has: the external symbol receiver.name or name; else a virtual
    node external:receiver.name where there is a receiver of dotted names. Of several symbols the least id."""
    known = functions.select(F.col("name").alias("called_name")).distinct()
    c = calls.where("called_name is not null").select("call_id", "called_name", "receiver").distinct().join(known, "called_name", "left_anti")
    whole = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "called_name")).otherwise(F.col("called_name"))
    e = external.groupBy(F.col("qualified_name").alias("whole")).agg(F.min("id").alias("by_qn"))
    s = external.groupBy(F.col("name").alias("called_name")).agg(F.min("id").alias("by_name"))
    j = c.withColumn("whole", whole).join(e, "whole", "left").join(s, "called_name", "left")
    virtual = F.when(F.col("receiver").rlike(r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*$"), F.concat(F.lit("external:"), "whole"))
    return j.select("call_id", F.coalesce("by_qn", "by_name", virtual).alias("target_id")).where("target_id is not null")


def resolve_ranked(calls: DataFrame, functions: DataFrame, classes: DataFrame, inherited: DataFrame, external: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges of all calls by the first strategy that has candidates: super call, receiver's type and its ancestors, same
    package, external. Columns as in `disambiguate`. functions carry `parsed` parameters."""
    scratch = scratch or Scratch(calls.sparkSession)
    calls, functions, classes, inherited = (scratch.save(x) for x in (calls, functions, classes, inherited))  # each is read often
    owner = S.owner_name(F.col("qualified_name")).alias("qualified_name")
    methods = functions.select("id", "name", owner).join(classes.select(F.col("id").alias("owner"), "qualified_name"), "qualified_name").select("id", "name", "owner")
    types = scratch.save(receiver_types(calls, functions, classes, inherited))
    ranked = (
        super_calls(calls, methods, classes, inherited).withColumn("rank", F.lit(0)).withColumn("exact", F.lit("super_call"))
        .unionByName(methods_of_types(calls, types, methods, inherited).select("call_id", "id", F.lit(1).alias("rank"), F.when(F.col("level") == 0, "type_exact").otherwise("hierarchy").alias("exact")))
        .unionByName(same_package(calls, functions).withColumn("rank", F.lit(2)).withColumn("exact", F.lit("same_package")))
    )
    ranked = scratch.save(ranked)
    best = scratch.save(ranked.join(ranked.groupBy("call_id").agg(F.min("rank").alias("rank")), ["call_id", "rank"]))
    of = best.groupBy("call_id").agg(F.max("exact").alias("exact"))
    value = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    out = disambiguate(calls, best, functions, "exact").join(of, "call_id")
    alone = F.col("resolved_by") == "exact"
    out = out.select("call_id", "target_id", F.when(alone, F.col("exact")).otherwise(F.col("resolved_by")).alias("resolved_by"), F.when(alone, value[F.col("exact")]).otherwise(F.col("confidence")).alias("confidence"), "candidates")
    ext = external_targets(calls, external, functions).select("call_id", "target_id", F.lit("external").alias("resolved_by"), F.lit(CONFIDENCE["external"]).alias("confidence"), F.lit(1).alias("candidates"))
    return out.unionByName(ext.join(best.select("call_id").distinct(), "call_id", "left_anti"))


def callback_references(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """call_id, id: functions of the caller's file that a call names in its arguments (a bare name, X::name or this.name)."""
    args = calls.where("arg_exprs is not null").select("call_id", "file_path", F.explode(F.array_distinct("arg_exprs")).alias("a"))
    named = args.select("call_id", "file_path", F.regexp_extract("a", r"^(?:[\w$]+::|this\.|self\.)?([A-Za-z_$][\w$]*)$", 1).alias("name")).where("name <> ''").distinct()
    return named.join(functions.select("id", "name", "file_path"), ["file_path", "name"]).select("call_id", "id").distinct()
