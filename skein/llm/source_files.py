"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.syntax.validity import LANGUAGE_OF, MOST_EDITS, repair

REPAIR_SCHEMA = "rel_path string, source_project string, language string, edit_cost int, kind string, line int, exact boolean"
#: A regular expression over the extension; files of other languages are left out.
KNOWN = r"\.(java|go|py|ts|js)$"


def known_files(files: DataFrame) -> DataFrame:
    """Path, project and content of the files whose extension names a known language. A null path is left out."""
    return files.where(F.col("rel_path").rlike(KNOWN)).select("rel_path", "source_project", "content")


def syntax_repairs(files: DataFrame, most: int | None = MOST_EDITS) -> DataFrame:
    """Minimum-cost syntax repair of each file, by error-correcting chart parsing.

    files: rel_path, source_project, content (binary, UTF-8). The language is that of the extension. Lexical faults, a
    bracket chart and a chart per statement (see `skein.llm.syntax`) give edit_cost; 0 means that the file parses. kind
    tells from the edits' places: conflict, truncation, mismatch (another language or no code), else edit; '' if valid.
    exact tells whether edit_cost is the least number of edits: up to `most` edits are searched for in a statement, and
    one that takes more counts most + 1; None searches without a bound (slow for files of another language). Beside
    lexical and bracket faults statements are not parsed, so their cost is a lower bound too.

    One row per input row; a null content counts as empty, and an empty file is valid except in Go. Files are
    independent, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, projects, contents = (batch.column(i) for i in range(3))
            languages, found = [], []
            for path, content in zip(paths, contents):
                language = LANGUAGE_OF[path.as_py().rsplit(".", 1)[1]]
                languages.append(language)
                found.append(repair(language, content.as_py(), most)[0])
            columns = [paths, projects, pa.array(languages, pa.string()), pa.array([r.cost for r in found], pa.int32()), pa.array([r.kind for r in found], pa.string()), pa.array([r.line for r in found], pa.int32()), pa.array([r.exact for r in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["rel_path", "source_project", "language", "edit_cost", "kind", "line", "exact"])

    return known_files(files).mapInArrow(run, REPAIR_SCHEMA)


def invalid_files(files: DataFrame) -> DataFrame:
    """The files with a nonzero repair cost, each once: rel_path, source_project, language, edit_cost, kind, line, exact."""
    found = syntax_repairs(files).where("edit_cost > 0")
    return found.groupBy("rel_path").agg(*[F.min(F.struct("edit_cost", "kind", "line", "exact", "source_project", "language")).getField(c).alias(c) for c in ("source_project", "language", "edit_cost", "kind", "line", "exact")])


def invalid_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per source_project and language; a repeated file counts once."""
    each = syntax_repairs(files).groupBy("rel_path", "source_project", "language").agg(F.max("edit_cost").alias("edit_cost"))
    bad = F.sum((F.col("edit_cost") > 0).cast("long"))
    return each.groupBy("source_project", "language").agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_invalid"), (bad / F.count(F.lit(1))).alias("rate"))
