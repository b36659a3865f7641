"""Full and incremental index of source files: facts and fingerprints per branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.sources.extract import file_facts
from skein.sources.store import GraphStore
from skein.storage import Scratch

# Fixed value: greatest size of a source file.
MAX_BYTES = 2 * 1024 * 1024


def source_scan(files: DataFrame, include_tests: bool = False, max_bytes: int = MAX_BYTES, rules: tuple[str, ...] = ()) -> DataFrame:
    """rel_path, language, size, mod_time, content, skipped: every file with the reason why it is left out ('' if it is not):
    language, ignored, test or size, in this order. A null content or path is left out as language or size 0. Repeated rows
    of a path count once (the latest mod_time, then the greatest content)."""
    path = F.col("rel_path")
    size = F.coalesce(F.length("content"), F.lit(0))
    reason = F.when(path.isNull() | (S.language_of(path) == ""), "language").when(S.in_ignored_directory(path, rules), "ignored")
    if not include_tests:
        reason = reason.when(S.in_test_directory(path) | S.is_test_file(path), "test")
    one = files.groupBy("rel_path").agg(F.max(F.struct("mod_time", "content")).alias("m")).select("rel_path", "m.mod_time", "m.content")
    return one.select("rel_path", S.language_of(path).alias("language"), size.alias("size"), "mod_time", "content", reason.when(size > max_bytes, "size").otherwise("").alias("skipped"))


def fingerprints(scan: DataFrame) -> DataFrame:
    """path, mod_time, size, content_hash of the files that are indexed."""
    return scan.where("skipped = ''").select(F.col("rel_path").alias("path"), "mod_time", "size", F.sha2("content", 256).alias("content_hash"))


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of the files that differ between stored and present fingerprints: added, modified (time or size, and
    then the hash), deleted."""
    a = old.select("path", F.struct("mod_time", "size").alias("a"), F.col("content_hash").alias("ha"))
    b = new.select("path", F.struct("mod_time", "size").alias("b"), F.col("content_hash").alias("hb"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when((F.col("a") != F.col("b")) & ~F.col("ha").eqNullSafe(F.col("hb")), "modified")
    return a.join(b, "path", "full").select("path", status.alias("status")).where("status is not null")


def change_counts(changes: DataFrame) -> DataFrame:
    """added, modified, deleted, stale: one row."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.agg(n("added"), n("modified"), n("deleted"), (F.count("status") > 0).alias("stale"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, module, target: the file that an import means. imports: file_path, module; files: path.

    Relative modules (./x, ../x, and dots before Python names) are taken from the importing file's folder; others match a
    file whose path without extension ends with the module's segments. index and __init__ files stand for their folder. Of
    several files the one in the same project, then the shortest, then the least path counts; the last segment is joined on
    equality.
    """
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), "/(index|__init__)$", "")
    f = files.select("path", stem.alias("stem")).distinct().withColumn("last", F.substring_index("stem", "/", -1))
    module = F.col("module")
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    dots = F.length(F.regexp_extract(module, r"^(\.+)(?:$|[A-Za-z_])", 1))
    ups = F.when(dots > 0, dots - 1).otherwise(F.size(F.filter(F.split(module, "/"), lambda s: s == "..")))
    rest = F.when(dots > 0, F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")).when(module.startswith("."), F.regexp_replace(module, r"^(?:\.{1,2}/)+", "")).otherwise(F.when(module.contains("/"), module).otherwise(F.translate(module, ".", "/")))
    rest = F.regexp_replace(F.regexp_replace(rest, r"\.(js|ts|jsx|tsx|mjs)$", ""), r"/(index|\*)$", "")
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0))), "/")
    i = imports.where("module <> '' and file_path is not null").select("file_path", "module").distinct()
    i = i.withColumn("relative", module.startswith(".")).withColumn("rest", rest)
    i = i.withColumn("want", F.when(F.col("relative"), F.array_join(F.filter(F.array(base, F.col("rest")), lambda x: x != ""), "/")).otherwise(F.col("rest")))
    hit = i.withColumn("last", F.substring_index("want", "/", -1)).join(f, "last")
    ok = F.when(F.col("relative"), F.col("stem") == F.col("want")).otherwise((F.col("stem") == F.col("want")) | F.expr("endswith(stem, '/' || want)"))
    rank = F.struct((F.substring_index("path", "/", 1) != F.substring_index("file_path", "/", 1)).alias("other"), F.length("path").alias("n"), "path")
    return hit.where(ok & (F.col("path") != F.col("file_path"))).groupBy("file_path", "module").agg(F.min(rank).alias("m")).select("file_path", "module", F.col("m.path").alias("target"))


def importers(facts: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """path: files that import a changed one and are not changed themselves. changed: path."""
    links = import_targets(facts.where("fact = 'import'").select("file_path", F.col("parent").alias("module")), files)
    hit = links.join(changed.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select(F.col("file_path").alias("path")).distinct()
    return hit.join(changed.select("path").distinct(), "path", "left_anti")


def full_index(store: GraphStore, files: DataFrame, branch: str, at: int, project: str = "") -> None:
    """Scans, extracts and writes everything: tables facts and fingerprints of the branch, and a registry entry."""
    scan = Scratch(store.spark).save(source_scan(files))
    store.write("facts", file_facts(scan.where("skipped = ''").select("rel_path", "content")), branch)
    store.write("fingerprints", fingerprints(scan), branch)
    store.register(project, "", branch, at)


def incremental_index(store: GraphStore, files: DataFrame, branch: str, at: int, project: str = "") -> DataFrame:
    """Brings the branch up to date; returns path, status (added, modified, deleted, importer) of what was touched.

    Facts of deleted, changed and importing files are replaced; all others stay as they are. A branch without an index
    is indexed in full.
    """
    if not store.exists(f"fingerprints/branch={branch}"):
        full_index(store, files, branch, at, project)
        return store.read("fingerprints", branch).select("path", F.lit("added").alias("status"))
    scratch = Scratch(store.spark)
    scan = scratch.save(source_scan(files))
    now = fingerprints(scan)
    changes = scratch.save(classify_changes(store.read("fingerprints", branch), now))
    facts = store.read("facts", branch)
    near = importers(facts, now.select("path").unionByName(changes.where("status = 'deleted'").select("path")), changes)
    touched = scratch.save(changes.unionByName(near.select("path", F.lit("importer").alias("status"))))
    again = touched.where("status <> 'deleted'").select(F.col("path").alias("rel_path"))
    fresh = file_facts(scan.where("skipped = ''").join(again, "rel_path", "left_semi").select("rel_path", "content"))
    kept = facts.join(touched.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    store.replace("facts", kept.unionByName(fresh), branch)
    store.replace("fingerprints", now, branch)
    store.register(project, "", branch, at)
    return touched
