"""Resolution of raw calls to functions: candidates of all strategies, ranked, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import enum_constant
from skein.operators.lookup import hot_keys, lookup_join
from skein.operators.lookups import first_five

# Confidence of each strategy.
CONFIDENCE = {"pre_resolved": 0.95, "type_exact": 0.95, "same_file": 0.85, "arg_count": 0.85, "name_unique": 0.70, "external": 0.70}


def resolve_calls(calls: DataFrame, functions: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, hints). calls: call_id, called_name, file_path, arg_count, receiver_expr, is_pre_resolved.
    functions: id, name, qualified_name, file_path, n_params. external: id, name, qualified_name.

    Strategies in order, the first that gives one function wins: pre-resolved qualified name; one function of the name
    in the caller's file; one of the name and argument count; one of the name anywhere; one external symbol of the name.
    A call with several candidates and no winner becomes a hint with at most five of them and their number. Candidates
    are counted per name, file and arity before calls are joined to them, so a frequent name costs one row per call.
    Repeated rows of a call count once; null names give nothing.
    """
    c = calls.where("called_name is not null").select("call_id", "called_name", "file_path", "arg_count", "receiver_expr", F.coalesce("is_pre_resolved", F.lit(False)).alias("pre")).distinct()
    one = lambda df, keys, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias(name)).where("_n = 1").drop("_n")
    f = functions.select("id", F.col("name").alias("called_name"), "qualified_name", "file_path", F.col("n_params").alias("arg_count"))
    by_qn = functions.select("id", F.col("qualified_name").alias("called_name")).unionByName(external.select("id", F.col("qualified_name").alias("called_name"))).groupBy("called_name").agg(F.min("id").alias("pre_id"))
    by_file = one(f, ["called_name", "file_path"], "file_id")
    by_args = one(f, ["called_name", "arg_count"], "args_id")
    by_name = f.groupBy("called_name").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("any_id")).join(first_five(f.withColumnRenamed("called_name", "name"), "name").withColumnRenamed("name", "called_name"), "called_name")
    by_ext = one(external.select("id", F.col("name").alias("called_name")), ["called_name"], "ext_id")
    hot = hot_keys(c, ["called_name"])
    j = lookup_join(c, by_qn, ["called_name"], "left", hot).join(by_file, ["called_name", "file_path"], "left")
    j = lookup_join(j, by_args, ["called_name", "arg_count"])
    j = lookup_join(lookup_join(j, by_name, ["called_name"], "left", hot), by_ext, ["called_name"], "left", hot)
    strategy = (
        F.when(F.col("pre") & F.col("pre_id").isNotNull(), "pre_resolved").when(F.col("file_id").isNotNull(), "same_file").when(F.col("args_id").isNotNull(), "arg_count")
        .when(F.col("candidates") == 1, "name_unique").when(F.col("candidates").isNull() & F.col("ext_id").isNotNull(), "external")
    )
    j = j.withColumn("resolved_by", strategy)
    target = F.expr("case resolved_by when 'pre_resolved' then pre_id when 'same_file' then file_id when 'arg_count' then args_id when 'name_unique' then any_id when 'external' then ext_id end")
    value = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[F.col("resolved_by")]
    edges = j.where("resolved_by is not null").select("call_id", target.alias("target_id"), "resolved_by", value.alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    r = F.coalesce("receiver_expr", F.lit(""))
    hint = (
        F.when((r == "super") | r.startswith("super."), "super_field_call").when(r.contains("("), "chained_call").when((r != "") & ~r.contains("."), "lambda_call")
        .when((r != "") & enum_constant(r), "enum_method").when(F.col("candidates") <= 9, "ambiguous_project_call").otherwise("untyped_receiver")
    )
    hints = j.where("resolved_by is null and candidates > 1").select("call_id", hint.alias("hint_type"), "candidates", "shown")
    return edges, hints


def fixpoint_types(bindings: DataFrame, copies: DataFrame, scratch, rounds: int = 10) -> DataFrame:
    """Types of variables: known bindings (scope, var, type) carried along copies (scope, lhs, rhs) until nothing new
    comes, at most `rounds` times. The first binding of a variable stays; of several new ones the least."""
    known = scratch.save(bindings.groupBy("scope", "var").agg(F.min("type").alias("type")))
    for _ in range(rounds):
        new = copies.join(known.withColumnRenamed("var", "rhs"), ["scope", "rhs"]).groupBy("scope", F.col("lhs").alias("var")).agg(F.min("type").alias("type"))
        new = scratch.save(new.join(known.select("scope", "var"), ["scope", "var"], "left_anti"))
        if new.isEmpty():
            break
        known = scratch.save(known.unionByName(new))
    return known


def export_closure(exports: DataFrame, reexports: DataFrame, scratch) -> DataFrame:
    """(file, symbol, origin): local exports, and those that wildcard re-exports (file, source) hand on, to a fix-point."""
    known = scratch.save(exports.select("file", "symbol", F.col("file").alias("origin")).distinct())
    new = known
    while True:
        step = reexports.join(new.withColumnRenamed("file", "source"), "source").select("file", "symbol", "origin").distinct()
        new = scratch.save(step.join(known, ["file", "symbol", "origin"], "left_anti"))
        if new.isEmpty():
            return known
        known = scratch.save(known.unionByName(new))


def linearise(heritage: DataFrame) -> DataFrame:
    """C3 linearisation per class: class_name, mro (array). heritage: root (component), child, parents (array in order).

    Each connected hierarchy is one group, as the merge needs all its classes; an inconsistent order appends the rest.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parents = {r.child: list(r.parents) for r in pdf.itertuples()}
        done: dict[str, list[str]] = {}

        def order(name: str) -> list[str]:
            stack, open_ = [name], set()
            while stack:
                n = stack[-1]
                waiting = [p for p in parents.get(n, []) if p not in done and p not in open_]
                if waiting and n not in open_:
                    open_.add(n)
                    stack += reversed(waiting)
                    continue
                stack.pop()
                lists = [list(done.get(p, [p])) for p in parents.get(n, [])] + [list(parents.get(n, []))]
                out = [n]
                while any(lists):
                    head = next((x[0] for x in lists if x and not any(x[0] in y[1:] for y in lists)), None)
                    if head is None:
                        out += list(dict.fromkeys(c for x in lists for c in x if c not in out))
                        break
                    out.append(head)
                    lists = [[c for c in x if c != head] for x in lists]
                done[n] = out
            return done[name]

        return pd.DataFrame({"class_name": list(parents), "mro": [order(c) for c in parents]})

    return heritage.groupBy("root").applyInPandas(run, "class_name string, mro array<string>")
