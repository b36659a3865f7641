"""The tools of the code graph: every question as a method with its arguments, answered as a DataFrame.

    tools = Tools(spark, "/data/tables")
    tools.query_call_chain("com.x.Service.run", depth=3).show()

Names resolve as in `find_functions`. A result is never cut but by the limit and offset that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view
from skein.operators import forest, modes
from skein.operators import lookups as L
from skein.operators.routes import match_routes
from skein.operators.traverse import Subgraph, ancestors, call_chain, truncated
from skein.sources import index as indexing
from skein.sources.store import GraphStore
from skein.storage import Scratch, read_table

_NODE = ("id", "name", "qualified_name", "file_path", "start_line", "end_line")
MODES = ("full", "core", "dry", "compact")


class Tools:
    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables

    def _view(self, name: str) -> DataFrame:
        return view(self.spark, self.tables, name)

    def _nodes(self) -> DataFrame:
        part = lambda v, kind: self._view(v).select(*_NODE, F.lit(kind).alias("kind"))
        return part("fn", "Function").unionByName(part("cls", "Class"))

    # ---- Projects and index

    def list_projects(self) -> DataFrame:
        f = read_table(self.spark, self.tables, "fingerprint_files")
        return f.groupBy("source_project", "branch").agg(F.max("last_indexed_at").alias("last_indexed_at"), F.max_by("last_commit", "last_indexed_at").alias("last_commit"))

    def index_repository(self, store: GraphStore, branch: str, at: int, force: bool = False) -> DataFrame:
        """Brings an index of the files table up to date, or with force builds it anew; the touched files with their status."""
        files = read_table(self.spark, self.tables, "files").select("rel_path", "content", "mod_time")
        if force:
            store.clear("fingerprints", branch)
        return indexing.incremental_index(store, files, branch, at)

    def check_index_status(self, store: GraphStore, branch: str) -> DataFrame:
        """added, modified, deleted, stale, message of a branch's index against the files table; one row."""
        if not store.exists(f"fingerprints/branch={branch}"):
            counts = self.spark.createDataFrame([(0, 0, 0, True)], "added long, modified long, deleted long, stale boolean").withColumn("reason", F.lit("not_indexed"))
        else:
            now = indexing.fingerprints(indexing.source_scan(read_table(self.spark, self.tables, "files").select("rel_path", "content", "mod_time")))
            counts = indexing.change_counts(indexing.classify_changes(store.read("fingerprints", branch), now)).withColumn("reason", F.when(F.col("stale"), "files_changed").otherwise(""))
        return counts.withColumn("message", S.staleness_message(F.col("reason"), F.lit(""), F.lit(""), F.col("added"), F.col("modified"), F.col("deleted")))

    def overview(self) -> DataFrame:
        """kind, n: nodes and edges per kind, files per language."""
        n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n(self._view("fn"), "Function").unionByName(n(self._view("cls"), "Class")).unionByName(n(self._view("route"), "Route"))
        edges = read_table(self.spark, self.tables, "edges").select("edge_id", "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        files = read_table(self.spark, self.tables, "files").groupBy(F.concat(F.lit("file:"), F.coalesce(F.lower("language"), F.lit(""))).alias("kind")).agg(F.countDistinct("rel_path").alias("n"))
        return out.unionByName(edges).unionByName(files)

    # ---- Symbols

    def query_symbol(self, name: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return L.page(L.by_name(self._nodes(), name), L.ORDER, offset, limit)

    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        hits = self._nodes().where(F.col("name").contains(query) | F.col("qualified_name").contains(query))
        fields = L.fields_of(self._view("cls")).where(F.col("field").contains(query) | F.col("type").contains(query))
        fields = fields.join(self._view("cls").select(F.col("id").alias("class_id"), "file_path", "start_line", "end_line", F.col("qualified_name").alias("q")), "class_id")
        as_nodes = fields.select(F.concat_ws("::", "class_id", F.lit("field"), "field").alias("id"), F.col("field").alias("name"), F.concat_ws(".", "q", "field").alias("qualified_name"), "file_path", "start_line", "end_line", F.lit("Field").alias("kind"))
        return L.page(hits.unionByName(as_nodes), L.ORDER, offset, limit)

    def find_functions(self, name: str) -> DataFrame:
        """Functions a name can mean: by qualified name, by its end, by short name, else the method of that name that the
        class inherits from its nearest ancestor (five levels)."""
        fn = self._view("fn")
        found = L.resolve(fn, self.spark.createDataFrame([(name,)], "text string")).select("id")
        if "." not in name or not found.isEmpty():
            return found
        owner, method = name.rsplit(".", 1)
        cls = self._view("cls").where((F.col("qualified_name") == owner) | F.col("qualified_name").endswith("." + owner) | (F.col("name") == owner))
        up = ancestors(self._view("extends_edge"), 5, Scratch(self.spark)).join(cls.select("id"), "id", "left_semi")
        near = up.join(self._view("cls").select(F.col("id").alias("ancestor"), F.col("qualified_name").alias("q")), "ancestor").join(fn.where(F.col("name") == method).select(F.col("id").alias("f"), S.owner_name(F.col("qualified_name")).alias("q")), "q")
        return near.groupBy("id").agg(F.min(F.struct("level", "f")).alias("m")).select(F.col("m.f").alias("id")).distinct()

    def query_class_members(self, class_name: str, limit: int = 50) -> DataFrame:
        cls = self._view("cls").where((F.col("name") == class_name) | (F.col("qualified_name") == class_name) | F.col("qualified_name").endswith("." + class_name))
        methods = self._view("fn").select(S.owner_name(F.col("qualified_name")).alias("qualified_name"), F.col("name").alias("member"), "start_line")
        a = cls.select(F.col("id").alias("class_id"), "qualified_name").join(methods, "qualified_name").select("class_id", F.lit("method").alias("kind"), "member", "start_line")
        b = L.fields_of(cls).select("class_id", F.lit("field").alias("kind"), F.col("field").alias("member"), F.lit(None).cast("int").alias("start_line"))
        return L.page(a.unionByName(b), ["class_id", "kind", "start_line", "member"], 0, limit)

    def query_by_annotation(self, annotation: str, kind: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        owners = self._view("annotation").where(F.col("name") == annotation).select(F.col("owner").alias("id")).distinct()
        nodes = self._nodes() if not kind else self._nodes().where(F.col("kind") == kind)
        return L.page(nodes.join(owners, "id", "left_semi"), L.ORDER, offset, limit)

    def query_by_layer(self, layer: str, limit: int = 50, offset: int = 0) -> DataFrame:
        owners = self._view("annotation").where(F.col("layer") == layer).select(F.col("owner").alias("id")).distinct()
        return L.page(self._nodes().join(owners, "id", "left_semi"), L.ORDER, offset, limit)

    def query_dependencies(self, symbol: str, kind: str = "CALLS", reverse: bool = False) -> DataFrame:
        near, far = ("dst", "src") if reverse else ("src", "dst")
        e = read_table(self.spark, self.tables, "edges").where(F.col("kind") == kind).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
        one = L.page(L.by_name(self._nodes(), symbol), L.ORDER, 0, 1).select(F.col("id").alias(near))
        return e.join(one, near, "left_semi").join(self._nodes().select(F.col("id").alias(far), "qualified_name", "file_path"), far, "left")

    def query_usages(self, symbol: str, limit: int = 0, offset: int = 0) -> DataFrame:
        v = self._view("variable").where(F.col("qualified_name").contains(symbol)).select(F.col("id").alias("dst"), F.col("qualified_name").alias("variable"))
        u = self._view("uses").join(v, "dst").groupBy("variable", "src").agg(F.min(F.struct("line", "ref_kind")).alias("m")).select("variable", F.col("src").alias("id"), "m.line", "m.ref_kind")
        return L.page(u.join(self._view("fn").select("id", "qualified_name", "file_path", "start_line"), "id"), ["variable", *L.ORDER], offset, limit)

    def locate_function(self, locations: list[tuple[str, int]]) -> DataFrame:
        asked = self.spark.createDataFrame(locations, "file_path string, line int")
        hit = L.smallest_span(asked, self._view("fn")).join(self._view("fn").select("id", "qualified_name"), "id")
        return asked.join(hit, ["file_path", "line"], "left")

    # ---- Chains

    def _chain(self, roots: DataFrame, depth: int, reverse: bool, min_confidence: float) -> Subgraph:
        return call_chain(self._view("fn"), self._view("call_edge"), self._view("dispatch_edge"), roots, depth, reverse, min_confidence)

    def query_call_chain(self, function: str, depth: int = 3, min_confidence: float = 0.0, reverse: bool = False, mode: str = "dry") -> DataFrame:
        """Edges of the chain of every function the name means; mode: full, core (without accessors and externals), dry
        (also without log calls and the like), compact (dry, one edge per pair with its lines)."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        sub = self._chain(self.find_functions(function), depth, reverse, min_confidence)
        nodes, edges = sub.nodes.join(self._view("fn").select("id", "name", "qualified_name", "file_path", "is_getter", "is_setter", "is_constructor"), "id"), sub.edges
        if mode != "full":
            nodes, edges = modes.core(nodes, edges)
        if mode in ("dry", "compact") and not reverse:
            nodes, edges = modes.dry(nodes, edges, Scratch(self.spark))
        return modes.compact(edges) if mode == "compact" else edges.select("root", "src", "dst", "kind", "level", "line", "confidence", "declared_type")

    def truncated_nodes(self, function: str, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
        sub = self._chain(self.find_functions(function), depth, False, min_confidence)
        return truncated(sub, self._view("fn"), self._view("call_edge"), self._view("dispatch_edge"), min_confidence)

    def impact_analysis(self, symbol: str, depth: int = 3) -> DataFrame:
        """Functions that reach the symbol, with the routes they handle."""
        sub = self._chain(self.find_functions(symbol), depth, True, 0.0)
        routes = self._view("handles").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("routes"))
        return sub.nodes.join(routes, "id", "left").select("root", "id", "level", "routes")

    def query_cross_chain(self, function: str, depth: int = 3) -> DataFrame:
        """Calls out of the function's project that its chain reaches, by project."""
        e = self._chain(self.find_functions(function), depth, False, 0.0).edges.where("kind = 'CALLS'")
        p = lambda end, out: self._view("fn").select(F.col("id").alias(end), F.col("source_project").alias(out))
        return e.join(p("src", "a"), "src").join(p("dst", "b"), "dst").where("a <> b").groupBy("root", F.col("b").alias("project")).agg(F.countDistinct("src", "dst").alias("n_calls"))

    # ---- Routes and entry points

    def query_routes(self, method: str = "", type: str = "http") -> DataFrame:
        r = self._view("route")
        command = F.col("method").isin("CLI", "TOOL")
        r = r.where({"http": ~command, "cli": F.col("method") == "CLI", "mcp": F.col("method") == "TOOL", "all": F.lit(True)}[type])
        return (r.where(F.upper("method") == method.upper()) if method else r).select("id", "method", "path", "framework")

    def match_route(self, method: str, path: str) -> DataFrame:
        return match_routes(self.spark.createDataFrame([(method.upper(), path)], "method string, path string"), self._view("route"))

    def query_route_chain(self, route: str, method: str = "", max_depth: int = 10) -> DataFrame:
        """Nodes below the last handler of the routes with this path (else those that contain it)."""
        r = self._view("route")
        r = r.where(F.upper("method") == method.upper()) if method else r
        exact = r.where(F.col("path") == route)
        found = r.where(F.col("path").contains(route)) if exact.isEmpty() else exact
        last = self._view("handles").groupBy(F.col("dst").alias("route_id")).agg(F.max_by("src", "handler_order").alias("handler")).join(found.select(F.col("id").alias("route_id")), "route_id")
        sub = self._chain(last.select(F.col("handler").alias("id")).distinct(), max_depth, False, 0.0)
        below = last.join(sub.nodes.withColumnRenamed("root", "handler"), "handler").select("route_id", "id", "level")
        return last.select("route_id", F.col("handler").alias("id"), F.lit(0).alias("level")).unionByName(below)

    def analyze_repository(self) -> DataFrame:
        """id, kind, score of every entry point."""
        from skein.queries.analysis import n01_entry_points

        return n01_entry_points(self.spark, self.tables)

    def query_entry_points(self, type: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        e = self._view("fn").where("entry_type <> ''")
        return L.page((e.where(F.col("entry_type") == type) if type else e).select(*_NODE, "entry_type"), L.ORDER, offset, limit)

    def query_call_forest(self, type: str = "", depth: int = 5, mode: str = "dry") -> DataFrame:
        """Edges of the trees below the entry points of a kind (all but suspected_dead); without accessors unless mode is
        full."""
        entries = self.analyze_repository()
        entries = entries.where(F.col("kind") == type) if type else entries
        edges = forest.call_forest(self._view("fn"), self._view("call_edge"), self._view("dispatch_edge"), entries, depth)
        return edges if mode == "full" else forest.core_forest(edges, self._view("fn"), Scratch(self.spark))
