"""Point and set lookups, search, paging and sets over node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["file_path", "start_line", "id"]


def by_name(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name is `text`, or whose qualified name is if it holds a dot."""
    return nodes.where(F.col("qualified_name" if "." in text else "name") == text)


def by_property(nodes: DataFrame, key: str, value: str = "", mode: str = "exact") -> DataFrame:
    """mode: exact, contains (case counts) or not_empty (neither null nor '')."""
    c = F.col(key)
    return nodes.where({"exact": c == value, "contains": c.contains(value), "not_empty": c.isNotNull() & (c != "")}[mode])


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 of a total order (limit 0: all), with the total. A page is a limit by purpose;
    only offset + limit rows are gathered for it."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return (rows.limit(limit) if limit else rows).crossJoin(F.broadcast(total))  # one row


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates of function names (column text), with their rank: 0 same qualified name, 1 qualified name ends with it
    behind a dot, 2 same short name. Only the best rank of a name stays; n_candidates > 1 means it is ambiguous."""
    short = F.substring_index("text", ".", -1)
    n = nodes.select("id", "name", "qualified_name")
    hits = wanted.select("text", short.alias("name")).distinct().join(n, "name")
    rank = F.when(F.col("qualified_name") == F.col("text"), 0).when(F.expr("endswith(qualified_name, '.' || text)"), 1).when(~F.col("text").contains("."), 2)
    ranked = hits.withColumn("rank", rank).where("rank is not null")
    best = ranked.groupBy("text").agg(F.min("rank").alias("rank"))
    kept = ranked.join(best, ["text", "rank"])
    n_of = kept.groupBy("text").agg(F.count(F.lit(1)).alias("n_candidates"))
    return kept.join(n_of, "text").select("text", "id", "rank", "n_candidates")


def search(parts: list[tuple[str, DataFrame]], text: str) -> DataFrame:
    """Case-sensitive substring search on name and qualified name over several kinds of nodes."""
    out = None
    for kind, df in parts:
        hit = df.where(F.col("name").contains(text) | F.col("qualified_name").contains(text)).select(F.lit(kind).alias("kind"), "id", "name", "qualified_name", "file_path")
        out = hit if out is None else out.unionByName(hit)
    return out


def fields_of(classes: DataFrame) -> DataFrame:
    """Fields in the classes' JSON: class_id, field, type."""
    parsed = F.from_json("fields", "array<struct<name:string,type:string>>")
    return classes.select(F.col("id").alias("class_id"), F.explode(parsed).alias("f")).select("class_id", F.col("f.name").alias("field"), F.col("f.type").alias("type"))


def smallest_span(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """For each (file_path, line): the innermost function around it. Spans are exploded to blocks of 64 lines, so the
    join is on equality and compares a line with few spans."""
    width = 64
    spans = functions.where("end_line >= start_line").select("file_path", "start_line", "end_line", "id", F.explode(F.expr(f"sequence(start_line div {width}, end_line div {width})")).alias("block"))
    asked = requests.select("file_path", "line", F.expr(f"line div {width}").alias("block")).distinct()
    hit = asked.join(spans, ["file_path", "block"]).where("line between start_line and end_line")
    best = hit.groupBy("file_path", "line").agg(F.min(F.struct(F.expr("end_line - start_line").alias("span"), "id")).alias("b"))
    return best.select("file_path", "line", F.col("b.id").alias("id"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_five(df: DataFrame, key: str) -> DataFrame:
    """key, shown: the five least ids of each key, joined by commas. Ids are ranked by a window with a limit that Spark
    applies before the shuffle as well, so no more than five of a key are gathered anywhere."""
    w = Window.partitionBy(key).orderBy("id")
    few = df.select(key, "id").distinct().withColumn("_n", F.row_number().over(w)).where("_n <= 5")
    return few.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("shown"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def apply_updates(nodes: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes with the columns of `updates` (id, columns) put in where they are not null."""
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = nodes.join(new, "id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def delete_by_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of the files, and without the edges at them."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept
