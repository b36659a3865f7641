"""Build files, mappers, protocol and schema definitions of a project as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources import definitions as D

DEFINITIONS = "source_project string, file_path string, fact string, name string, detail string"
_BUILD = tuple(n for n, _ in D.BUILD_FILES)


def _facts(path: str, text: str) -> list[tuple[str, str, str]]:
    name = path.rsplit("/", 1)[-1]
    out: list[tuple[str, str, str]] = []
    if name in _BUILD:
        out.append(("build_file", name, dict(D.BUILD_FILES)[name]))
        out += [("framework", n, c) for n, c in D.frameworks([text])]
    out += [("module", m, name) for m in D.modules(name, text)]
    if name.startswith("tsconfig") and name.endswith(".json"):
        out += [("path_alias", a, t) for a, t in D.path_aliases(text)]
    if name.endswith(".xml") and "<mapper" in text:
        out += [("mapper_query", caller, f"{kind} {sql}") for caller, kind, sql in D.mapper_queries(text)]
    if name.endswith(".proto"):
        out += [("rpc", rpc, service) for service, rpc in D.proto_services(text)]
    if name.endswith((".graphql", ".graphqls", ".gql")):
        out += [("operation", field, kind) for kind, field in D.graphql_operations(text)]
    return out


def definition_facts(files: DataFrame) -> DataFrame:
    """build_file, framework, module, path_alias, mapper_query, rpc and operation facts of all definition files (rel_path,
    source_project, content). Other files, null paths and contents give no rows; files are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, p, *f) for s, p, c in zip(pdf.source_project, pdf.rel_path, pdf.content) for f in _facts(p, bytes(c).decode("utf-8-sig", "replace"))]
            yield pd.DataFrame(rows, columns=["source_project", "file_path", "fact", "name", "detail"])

    names = "|".join(n.replace(".", r"\.") for n in (*_BUILD, "settings.gradle", "settings.gradle.kts", "go.work"))
    wanted = F.col("rel_path").rlike(rf"(^|/)({names}|tsconfig[^/]*\.json|[^/]*\.(xml|proto|graphqls?|gql))$")
    return files.where(wanted & F.col("content").isNotNull()).select("source_project", "rel_path", "content").mapInPandas(run, DEFINITIONS)


def project_types(facts: DataFrame) -> DataFrame:
    """source_project, type, build_files: the type of the first build file in order of priority, and all there are."""
    order = F.create_map(*[x for i, n in enumerate(_BUILD) for x in (F.lit(n), F.lit(i))])
    b = facts.where("fact = 'build_file'").withColumn("rank", order[F.col("name")])
    return b.groupBy("source_project").agg(F.min(F.struct("rank", "detail")).alias("m"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("build_files")).select("source_project", F.col("m.detail").alias("type"), "build_files")


def project_frameworks(facts: DataFrame) -> DataFrame:
    """source_project, framework, category: each framework once, with its least category."""
    return facts.where("fact = 'framework'").groupBy("source_project", F.col("name").alias("framework")).agg(F.min("detail").alias("category"))


def definition_parsers(frameworks: DataFrame) -> DataFrame:
    """source_project, query_parser, schema_parser: which definition files a project's frameworks make worth reading."""
    has = lambda *n: F.max(F.col("framework").isin(*n))
    return frameworks.groupBy("source_project").agg(has("mybatis").alias("query_parser"), has("grpc", "graphql", "dubbo").alias("schema_parser"))
