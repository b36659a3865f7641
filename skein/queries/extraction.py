"""Queries over facts extracted from source text. Parsing has no SQL; tests use fixtures and the indexed functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.scalars import url_path, url_service
from skein.sources.extract import file_facts
from skein.sources.web_facts import web_facts
from skein.storage import read_table


def _facts(spark, sf, *kinds):
    return file_facts(read_table(spark, sf, "files").select("rel_path", "content").distinct()).where(F.col("fact").isin(*kinds))


def e01_symbols(spark, sf):
    return _facts(spark, sf, "function", "class").select("file_path", "fact", "qualified_name", "line", "end_line")


def e02_calls(spark, sf):
    return _facts(spark, sf, "call").select("file_path", "name", "qualified_name", "line", "parent", "detail")


def e18_imports(spark, sf):
    return _facts(spark, sf, "import").select("file_path", "name", "parent", "line")


def e12_heritage(spark, sf):
    return _facts(spark, sf, "extends", "implements", "embedding").select("file_path", "fact", "qualified_name", "parent")


def _web(spark, sf, fact, languages):
    facts = web_facts(read_table(spark, sf, "files").select("rel_path", "content").distinct())
    return facts.where((F.col("fact") == fact) & F.col("language").isin(*languages))


def _routes(key, languages, commands):
    """Routes of the languages: HTTP, RPC and GraphQL ones, or commands and tools."""

    def run(spark, sf):
        r = _web(spark, sf, "route", languages)
        return r.where(F.col("method").isin("CLI", "TOOL") if commands else ~F.col("method").isin("CLI", "TOOL")).select("file_path", "line", "method", F.col("target").alias("path"), F.col("name").alias("handler"), "framework").distinct()

    run.__name__ = key
    return run


def _remote(key, languages):
    def run(spark, sf):
        r = _web(spark, sf, "remote", languages).select("file_path", "line", "method", "target", F.col("framework").alias("protocol")).distinct()
        return r.withColumn("path", F.when(F.col("protocol") == "http", url_path(F.col("target"))).otherwise(F.col("target"))).withColumn("service", F.when(F.col("protocol") == "http", url_service(F.col("target"))).otherwise(F.substring_index("target", "/", 1)))

    run.__name__ = key
    return run


def _stored(key, languages):
    def run(spark, sf):
        q = _web(spark, sf, "query", languages)
        return q.select("file_path", "line", F.col("name").alias("variable"), F.col("target").alias("sql_text"), F.col("method").alias("query_type"), F.col("framework").alias("tables"), F.col("detail").alias("conditions")).distinct()

    run.__name__ = key
    return run


def e07_annotations(spark, sf):
    """Annotations and decorators with their arguments and owners."""
    a = _web(spark, sf, "annotation", ("java", "python", "typescript", "javascript"))
    return a.select("file_path", "line", F.col("name").alias("annotation"), F.col("target").alias("owner"), F.col("method").alias("owner_kind"), F.col("detail").alias("arguments")).distinct()


def e28_conditional_queries(spark, sf):
    """Stored queries that are built in parts, with the parts added under a condition."""
    q = _web(spark, sf, "query", ("java", "go", "python", "typescript", "javascript")).where("detail not in ('', 'literal')")
    return q.select("file_path", "line", F.col("name").alias("variable"), F.col("target").alias("sql_text"), F.col("detail").alias("conditions")).distinct()


_ALL = ("java", "go", "python", "typescript", "javascript")


def e03_lambdas(spark, sf):
    """Lambdas with the variable they are bound to or the call they are handed to."""
    return _web(spark, sf, "lambda", _ALL).select("file_path", "line", F.col("name").alias("variable"), F.col("target").alias("handed_to"), F.col("detail").alias("receiver")).distinct()


def e04_generated_accessors(spark, sf):
    """Accessors that class annotations make for fields."""
    return _web(spark, sf, "accessor", ("java",)).select("file_path", "line", F.col("target").alias("class"), F.col("name").alias("accessor"), F.col("method").alias("type"), F.col("detail").cast("int").alias("n_params")).distinct()


def e05_switch_constants(spark, sf):
    """Constants that switch labels name."""
    return _web(spark, sf, "const_ref", _ALL).select("file_path", "line", F.col("name").alias("constant"), F.col("target").alias("path")).distinct()


def e06_assignments(spark, sf):
    """What variables are set to: copies, fields, results of calls and constructors."""
    return _web(spark, sf, "assignment", _ALL).select("file_path", "line", F.col("name").alias("variable"), F.col("target").alias("value"), F.col("method").alias("kind")).distinct()


def e08_chain_positions(spark, sf):
    """Calls of chains with their depth from the innermost call and the line of the outermost."""
    return _web(spark, sf, "chain", _ALL).select("file_path", "line", F.col("name").alias("called"), F.col("detail").cast("int").alias("chain_depth"), F.col("target").cast("int").alias("chain_line")).distinct()


def x33_complexity(spark, sf):
    """Cyclomatic complexity of every function: one more than its decisions, those of inner functions left to them."""
    from skein.operators.lookups import smallest_span

    files = read_table(spark, sf, "files").select("rel_path", "content").distinct()
    f = file_facts(files).where("fact = 'function'").select("file_path", "qualified_name", F.col("line").alias("start_line"), "end_line").distinct()
    f = f.withColumn("id", F.concat_ws(":", "file_path", "qualified_name", "start_line"))
    d = web_facts(files).where("fact = 'decision'").groupBy("file_path", "line").agg(F.count(F.lit(1)).alias("n"))
    n = d.join(smallest_span(d.select("file_path", "line"), f), ["file_path", "line"]).groupBy("id").agg(F.sum("n").alias("n"))
    return f.join(n, "id", "left").select("file_path", "qualified_name", "start_line", (F.coalesce("n", F.lit(0)) + 1).alias("complexity"))


_SCRIPT = ("typescript", "javascript")
MADE = [
    _routes("e09_java_routes", ("java",), False), _routes("e14_go_routes", ("go",), False), _routes("e19_python_routes", ("python",), False), _routes("e24_script_routes", _SCRIPT, False),
    _routes("e15_go_commands", ("go", "python"), True), _routes("e25_script_commands", _SCRIPT, True),
    _remote("e10_java_remote", ("java",)), _remote("e16_go_remote", ("go",)), _remote("e20_python_remote", ("python",)), _remote("e26_script_remote", _SCRIPT),
    _stored("e11_java_queries", ("java",)), _stored("e17_go_queries", ("go",)), _stored("e21_python_queries", ("python",)), _stored("e27_script_queries", _SCRIPT),
]


def queries() -> dict:
    return {f.__name__: f for f in (e01_symbols, e02_calls, e18_imports, e12_heritage, e03_lambdas, e04_generated_accessors, e05_switch_constants, e06_assignments, e07_annotations, e08_chain_positions, e28_conditional_queries, x33_complexity, *MADE)}


def oracle_sql() -> dict:
    return {}
