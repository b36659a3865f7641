"""Graph tables as Parquet folders, one partition per branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators.lookups import apply_updates, upsert


class GraphStore:
    """Tables under a folder, partitioned by branch. A write replaces the branches it holds and no others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, table: str) -> bool:
        fs, target = self._fs(self.path(table))
        return fs.exists(target)

    def drop(self, table: str) -> None:
        fs, target = self._fs(self.path(table))
        fs.delete(target, True)

    def migrate(self, schemas: dict[str, StructType]) -> list[str]:
        """Creates the tables that are not there, empty; names them. Columns that an older table lacks read as null."""
        made = [name for name in schemas if not self.exists(name)]
        for name in made:
            self.spark.createDataFrame([], schemas[name]).withColumn("branch", F.lit("")).write.partitionBy("branch").parquet(self.path(name))
        return made

    def write(self, table: str, df: DataFrame, branch: str) -> None:
        out = df.withColumn("branch", F.lit(branch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch").parquet(self.path(table))

    def append(self, table: str, df: DataFrame, branch: str) -> None:
        df.withColumn("branch", F.lit(branch)).write.mode("append").partitionBy("branch").parquet(self.path(table))

    def read(self, table: str, branch: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(StructType([*schema.fields]).add("branch", "string"))
        return reader.parquet(self.path(table)).where(F.col("branch") == branch).drop("branch")

    def replace(self, table: str, df: DataFrame, branch: str) -> None:
        """`write` of rows that may come from the table itself: they are put beside it first. An empty result empties the
        branch, which a dynamic overwrite alone would leave as it was."""
        beside = f"{table}__next"
        self.write(beside, df, branch)
        fs, target = self._fs(f"{self.path(table)}/branch={branch}")
        rows = self.read(beside, branch) if self.exists(f"{beside}/branch={branch}") else None
        if rows is None:
            fs.delete(target, True)
        else:
            self.write(table, rows, branch)
        self.drop(beside)

    def merge(self, table: str, df: DataFrame, branch: str, keys: list[str]) -> None:
        """Upsert by key: new rows replace old ones."""
        if not self.exists(table):
            return self.write(table, df, branch)
        self.replace(table, upsert(self.read(table, branch), df, keys), branch)

    def update(self, table: str, updates: DataFrame, branch: str, columns: list[str]) -> None:
        """Sets columns of the nodes named by updates (id, columns); nulls change nothing."""
        self.replace(table, apply_updates(self.read(table, branch), updates, columns), branch)

    def delete(self, nodes: str, edges: str, ids: DataFrame, branch: str) -> None:
        """Detach delete: the nodes of `ids` (id) and all edges (src, dst) at them."""
        gone = ids.select("id").where("id is not null").distinct()
        kept = self.read(nodes, branch).join(gone, "id", "left_anti")
        left = self.read(edges, branch)
        for end in ("src", "dst"):
            left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
        self.replace(edges, left, branch)
        self.replace(nodes, kept, branch)

    def delete_edges(self, table: str, ids: DataFrame, branch: str, end: str = "src") -> None:
        """Edges that begin (or with end='dst' end) at the nodes of `ids` (id)."""
        self.replace(table, self.read(table, branch).join(ids.select(F.col("id").alias(end)).distinct(), end, "left_anti"), branch)

    def clear(self, table: str, branch: str) -> None:
        fs, target = self._fs(f"{self.path(table)}/branch={branch}")
        fs.delete(target, True)

    def edges_with_ends(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Only edges whose two ends exist."""
        ids = nodes.select("id").distinct()
        return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    # ---- Registries and sinks

    def register(self, project: str, folder: str, branch: str, at: int) -> None:
        """Registry entry of a project's branch; registering again replaces it."""
        self.merge("registry", self.spark.createDataFrame([(project, folder, at)], "project string, folder string, indexed_at long"), branch, ["project"])

    def unregister(self, project: str, branch: str) -> None:
        self.replace("registry", self.read("registry", branch).where(F.col("project") != project), branch)

    def share(self, table: str, df: DataFrame) -> None:
        """Cross index: replaces exactly the (project, branch) partitions that df holds."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "branch").parquet(self.path(table))

    def dump(self, edges: DataFrame, name: str, by: str) -> None:
        """Debug dump: CSV with a header, a folder per value of `by`."""
        edges.write.mode("overwrite").partitionBy(by).option("header", True).csv(self.path(name))


def report(stats: DataFrame) -> tuple[str, str]:
    """(JSON, Markdown) of a small statistics table (kind, n), in order of kind."""
    import json

    rows = [(r[0], r[1]) for r in stats.orderBy("kind").select("kind", "n").collect()]
    return json.dumps({k: n for k, n in rows}, indent=2), "\n".join(["| Kind | Count |", "|---|---|", *(f"| {k} | {n} |" for k, n in rows)])
