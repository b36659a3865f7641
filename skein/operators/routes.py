"""Remote calls to routes: segments with wildcards, catch-alls, RPC services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S

PARAM = "{param}"


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """method, path, route_id: of each distinct (method, path) of calls the least route id that it meets.

    calls: method (upper case, '' for any), path. routes: id, method, path, framework. Paths compare by segments, a
    parameter on either side meeting anything; a route that ends in **, * or [...x] meets all longer paths. gRPC and GraphQL
    routes compare whole, case aside, and want the same method; Dubbo routes want all as spelled.

    Routes are reduced to the least id per (framework, method, path) first, so their number per path plays no part, then
    looked up by their first literal segment and length: only where that segment is a parameter do all paths of a length meet.
    Null paths meet nothing.
    """
    paths = calls.where("path is not null").select("method", "path").distinct()
    least = routes.where("path is not null").groupBy("framework", F.upper("method").alias("q"), F.col("path").alias("p")).agg(F.min("id").alias("id"))
    segs = lambda c: S.segments(S.path_params(F.col(c)))
    c = paths.withColumn("s", segs("path"))
    rpc = F.coalesce("framework", F.lit("")).isin("grpc", "graphql", "dubbo")
    whole = least.where(rpc).select("id", "q", "framework", "p", F.lower("p").alias("lp"))
    by_name = paths.withColumn("lp", F.lower("path")).join(whole, "lp").where((F.col("method") == F.col("q")) & ((F.col("framework") != "dubbo") | (F.col("path") == F.col("p")))).select("method", "path", "id")
    raw = S.segments(F.col("p"))
    r = least.where(~rpc).select("id", "q", segs("p").alias("t"), S.is_catch_all(F.coalesce(F.try_element_at(raw, F.lit(-1)), F.lit(""))).alias("open"))
    fits = (F.col("method") == "") | (F.col("q") == "") | (F.col("method") == F.col("q"))
    agree = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == PARAM) | (y == PARAM)), lambda ok: ok)
    first = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    # Closed routes: same length; key is (length, first segment), with the parameter as a key of its own on both sides.
    closed = r.where("not open").select("id", "q", "t", F.size("t").alias("n"), first(F.col("t")).alias("head"))
    keyed = c.select("method", "path", "s", F.size("s").alias("n"), F.explode(F.array_distinct(F.array(first(F.col("s")), F.lit(PARAM)))).alias("head"))
    a = keyed.join(closed, ["n", "head"])
    wild = c.select("method", "path", "s", F.size("s").alias("n")).where(F.try_element_at("s", F.lit(1)) == PARAM).join(closed.where(F.col("head") != PARAM).drop("head"), "n")
    closed_hits = a.select("method", "path", "s", "id", "q", "t").unionByName(wild.select("method", "path", "s", "id", "q", "t")).where(fits & agree(F.col("s"), F.col("t")))
    # Catch-alls: the path's heads of every length against the route without its last segment.
    opened = r.where("open").select("id", "q", F.slice("t", F.lit(1), F.size("t") - 1).alias("t")).withColumn("n", F.size("t"))
    heads = c.select("method", "path", "s", F.explode(F.sequence(F.lit(0), F.size("s"))).alias("n"))
    open_hits = heads.join(opened, "n").where(fits & agree(F.slice("s", F.lit(1), F.col("n")), F.col("t")))
    every = by_name.unionByName(closed_hits.select("method", "path", "id")).unionByName(open_hits.select("method", "path", "id"))
    return every.groupBy("method", "path").agg(F.min("id").alias("route_id"))
