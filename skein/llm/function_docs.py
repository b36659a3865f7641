"""Functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.doc_text import real_documentation
from skein.llm.source_files import known_files
from skein.storage import Scratch
from skein.syntax.lexers import Lexed
from skein.llm.syntax.validity import LANGUAGE_OF, _width, repair

TOKEN_SCHEMA = "rid long, rel_path string, lang byte, pos int, kind string, text string, line int, end_line int"
LANGUAGES = ("java", "go", "python", "typescript", "javascript")
_KEPT = {"=", "=>", "@", ":", "<", ">", ".", ",", "*", "|", "[", "]"}
_LITERAL_BEFORE = {"=", ":", ",", "[", "(", "return", "?", "&&", "||", "??"}


def _brace_rows(language: str, lexed: Lexed, text: str) -> list[tuple]:
    """Tokens outside parentheses; each ( carries the text up to its ). Brace groups within parentheses count only
    where they are bodies; literals are left out."""
    merged = sorted(lexed.tokens + lexed.comments, key=lambda t: t.start)
    close: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(merged):
        if t.kind in ("(", "[", "{"):
            stack.append(i)
        elif t.kind in (")", "]", "}") and stack:
            close[stack.pop()] = i
    js = language in ("javascript", "typescript")
    rows, inside, i, n, last = [], [], 0, len(merged), ""
    while i < n:
        t = merged[i]
        k = t.kind
        if k == "NL":
            i += 1
            continue
        hidden = bool(inside) and inside[-1] in "(["
        if k == "{":
            body = last in (")", "=>", "->") or not hidden and not (last in _LITERAL_BEFORE and (js or language == "java"))
            if not body:
                i = close.get(i, n - 1) + 1
                last = "}"
                continue
            inside.append("{")
            rows.append((t.start, "{", "", t.line, t.line))
        elif k == "}":
            if inside:
                inside.pop()
            rows.append((t.start, "}", "", t.line, t.line))
        elif k in "([":
            if not hidden:
                e = merged[close[i]].start if i in close else len(text)
                rows.append((t.start, k, " ".join(text[t.end : e].split()), t.line, t.line))
            inside.append(k)
        elif k in (")", "]"):
            if inside:
                inside.pop()
            if not (inside and inside[-1] in "(["):
                rows.append((t.start, k, "", t.line, t.line))
        elif hidden:
            pass
        elif k == "CMT":
            s = text[t.start : t.end]
            rows.append((t.start, k, s, t.line, t.line + s.replace("\r\n", "\n").count("\n")))
            i += 1
            continue
        elif k == ";" or k in _KEPT:
            rows.append((t.start, k, "", t.line, t.line))
        elif k.isidentifier() or k == "ID":
            if k not in ("STR", "NUM", "CHAR", "TPL", "REGEX"):
                rows.append((t.start, "ID" if k == "ID" else "WORD", text[t.start : t.end], t.line, t.line))
        last = k
        i += 1
    return rows


def _python_rows(lexed: Lexed, text: str) -> list[tuple]:
    """Logical lines with { and } for INDENT and DEDENT and ; for the end of a simple statement."""
    rows: list[tuple] = []
    indents = [0]
    line: list = []
    pos = 0

    def put(kind: str, s: str, at: int) -> None:
        nonlocal pos
        rows.append((pos, kind, s, at, at))
        pos += 1

    expect = False

    def flush() -> None:
        nonlocal line, expect
        if not line:
            return
        first = line[0]
        begin = max(text.rfind("\n", 0, first.start), text.rfind("\r", 0, first.start)) + 1
        space = text[begin : first.start]
        width = _width(space, 8) if not space.strip() else indents[-1]
        if expect:
            put("{", "", line[0].line)
            indents.append(width)
            expect = False
        else:
            while len(indents) > 1 and width < indents[-1]:
                indents.pop()
                put("}", "", first.line)
        head = next((t.kind for t in line if t.kind != "async"), "")
        depth, colon = 0, -1
        for i, t in enumerate(line):
            depth += (t.kind in "([{") - (t.kind in ")]}")
            if t.kind == ":" and depth == 0 and head in ("def", "class", "if", "elif", "else", "while", "for", "try", "except", "finally", "with", "match", "case"):
                if head not in ("match", "case") or i == len(line) - 1:
                    colon = i
                    break
        shown = line if head in ("def", "class") or line[0].kind == "STR" else line[:1]
        depth = 0
        for i, t in enumerate(shown):
            if head in ("def", "class") and 0 <= colon < i:
                break
            if t.kind == "(" and depth == 0:
                d, e = 1, i + 1
                while e < len(line) and d:
                    d += (line[e].kind in "([{") - (line[e].kind in ")]}")
                    e += 1
                put("(", " ".join(text[t.end : line[e - 1].start].split()), t.line)
            elif depth == 0 and t.kind not in ("[", "{"):
                s = text[t.start : t.end]
                put("ID" if t.kind == "ID" else "STR" if t.kind == "STR" else "WORD" if t.kind.isidentifier() else t.kind, s, t.line)
            depth += (t.kind in "([{") - (t.kind in ")]}")
        if colon >= 0 and colon == len(line) - 1:
            expect = True
        elif colon >= 0:
            rest = line[colon + 1 :]
            put("{", "", rest[0].line)
            put("STR" if rest[0].kind == "STR" else "WORD", text[rest[0].start : rest[0].end], rest[0].line)
            put(";", "", rest[0].line)
            put("}", "", rest[0].line)
        else:
            put(";", "", line[-1].line)
        line = []

    for t in lexed.tokens:
        if t.kind == "NL":
            flush()
        else:
            line.append(t)
    flush()
    for _ in indents[1:]:
        put("}", "", text.count("\n") + 1)
    return rows


def lexed_tokens(files: DataFrame) -> DataFrame:
    """One row per token that bears on declarations, of the files that parse (repair cost 0). A file's first row has kind
    FILE and its path; no other row repeats it. lang is a place in LANGUAGES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "rel_path", "lang", "pos", "kind", "text", "line", "end_line"]
        for batch in batches:
            for rid, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                language = LANGUAGE_OF[path.rsplit(".", 1)[1]]
                found, lexed, text = repair(language, content)
                if found.cost or lexed is None:
                    continue
                rows = _python_rows(lexed, text) if language == "python" else _brace_rows(language, lexed, text)
                if not rows:
                    continue
                pos, kind, words, line, end = zip((-2, "FILE", "", 0, 0), (-1, ";", "", 0, 0), *rows)
                n = len(pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * n, pa.int64()), pa.array([path] + [None] * (n - 1), pa.string()), pa.array([LANGUAGES.index(language)] * n, pa.int8()), pa.array(pos, pa.int32()), pa.array(kind), pa.array(words), pa.array(line, pa.int32()), pa.array(end, pa.int32())], names
                )

    rows = known_files(files).select(F.monotonically_increasing_id().alias("rid"), "rel_path", "content")
    return rows.mapInArrow(run, TOKEN_SCHEMA)


# Words that begin a statement and are no method names.
_CONTROL = "if|for|while|switch|catch|synchronized|try|else|do|return|throw|new|case|assert|with|function"


def function_declarations(files: DataFrame) -> DataFrame:
    """Functions of all files that parse, each with its raw documentation.

    Tokens become rows; running sums over a file give the brace depth, a running count of delimiters makes islands of
    the tokens between { } and ; , and an island is a declaration or a statement. The block of a { ends at the next row
    of its depth. Comments lie in the island of their declaration, and lag windows tie those on following lines to blocks;
    docstrings are the row after its {.

    Columns: rel_path, language, qualified_name, name, params, start_line, end_line, style (block, lines, string), doc.
    Two rows of one path with the same content give the same functions once.
    """
    scratch = Scratch(files.sparkSession)
    tokens = lexed_tokens(files)
    w = Window.partitionBy("rid").orderBy("pos")
    delimiter = F.col("kind").isin("{", "}", ";")
    step = F.when(F.col("kind") == "{", 1).when(F.col("kind") == "}", -1).otherwise(0)
    rows = tokens.select(
        "*",
        F.sum(step).over(w).alias("depth"),
        F.coalesce(F.sum(delimiter.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("island"),
        F.lead("kind", 1).over(w).alias("k1"),
        F.lead("text", 1).over(w).alias("t1"),
        F.lead("kind", 2).over(w).alias("k2"),
        # A comment goes on with the one before if that is the row before and ends on the line above.
        ((F.col("kind") == "CMT") & F.coalesce((F.lag("kind").over(w) == "CMT") & (F.lag("end_line").over(w) == F.col("line") - 1), F.lit(False))).alias("goes_on"),
    )
    rows = rows.withColumn("block", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    level = F.when(F.col("kind") == "{", F.col("depth")).when(F.col("kind") == "}", F.col("depth") + 1)
    rows = rows.withColumn("level", level)
    ends = Window.partitionBy("rid", "level").orderBy("pos")
    rows = rows.withColumn("close", F.when(F.col("kind") == "{", F.lead("pos").over(ends))).withColumn("close_line", F.when(F.col("kind") == "{", F.lead("line").over(ends)))
    islands = rows.groupBy("rid", "lang", "island").agg(
        F.max("rel_path").alias("rel_path"),
        F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "line", "end_line", "block"))).alias("toks"),
        F.max(F.when(delimiter, F.struct("kind", "pos", "close", "close_line", "depth", "k1", "t1", "k2", "line"))).alias("end"),
    )
    islands = islands.withColumn("language", F.array(*map(F.lit, LANGUAGES))[F.col("lang")])
    code = F.filter("toks", lambda t: t["kind"] != "CMT")
    # Annotations and decorators are dropped from the header: @ Name ( . Name )* ( ... )?
    shown = F.transform(code, lambda t: F.when(t["kind"].isin("ID", "WORD", "STR"), F.regexp_replace(t["text"], r"\s", "")).otherwise(t["kind"]))
    islands = islands.withColumn("code", code).withColumn("head", F.regexp_replace(F.array_join(shown, " "), r"@ [\w$]+( \. [\w$]+)*( \( \))? ", ""))
    head, lang = F.col("head"), F.col("language")
    is_open, is_js = F.col("end.kind") == "{", lang.isin("javascript", "typescript")
    class_name = F.when(lang == "python", F.regexp_extract(head, r"^class ([\w]+)", 1)).when(
        lang != "go", F.regexp_extract(head, r"(?:^| )(?:class|interface|enum|record) (?!extends |implements )([\w$]+)", 1)
    )
    modifiers = r"^(?:(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp|readonly|override|async|get|set|export|declare) )*"
    plain = ~head.rlike(rf"(^| )({_CONTROL}) ") & ~head.rlike(" = | => ")
    method = F.when(plain, F.regexp_extract(head, r"(?:^| )\*? ?(#?[\w$]+) (?:< .*> )?\( \)(?: throws .*| : .*)? [{;]$", 1))
    java_name = F.when(head.rlike(r" \( \)(?: throws [^(]*)? [{;]$"), method)
    js_function = F.regexp_extract(head, r"^(?:(?:export|default|async|declare) )*function (?:\* )?([\w$]+) ", 1)
    js_arrow = F.regexp_extract(head, r"^(?:export )?const ([\w$]+) (?:: .*)?= (?:async )?(?:(?:< .*> )?\( \)(?: : .*)?|[\w$]+) =>", 1)
    islands = islands.select(
        "rid", "rel_path", "language", "toks", "code", "head", F.col("end.pos").alias("open"), F.when(is_open, F.col("end.close")).alias("close"), F.col("end.depth").alias("depth"), is_open.alias("is_open"),
        F.when(is_open, F.coalesce(F.col("end.close_line"), F.col("end.line"))).otherwise(F.col("end.line")).alias("end_line"),
        F.when(is_open, F.nullif(class_name, F.lit(""))).alias("klass"),
        F.nullif(F.when(lang == "python", F.regexp_extract(head, r"^(?:async )?def ([\w]+)", 1)).when(lang == "go", F.regexp_extract(head, r"^func (?:\( \) )?([\w]+) ", 1)).when(lang == "java", java_name).otherwise(F.when(is_open, js_function)), F.lit("")).alias("named"),
        F.when(is_js, F.nullif(method, F.lit(""))).alias("member"),
        F.when(is_js & (F.col("end.depth") - is_open.cast("int") == 0), F.nullif(js_arrow, F.lit(""))).alias("arrow"),
        F.when((lang == "python") & is_open & (F.col("end.k1") == "STR") & (F.col("end.k2") == ";") & F.col("end.t1").rlike("^[rRuU]?[\"']"), F.col("end.t1")).alias("docstring"),
        F.when((lang == "java") & head.startswith("package "), F.array_join(F.slice(F.transform(F.filter("code", lambda t: t["kind"].isin("ID", "WORD")), lambda t: t["text"]), 2, F.size("code")), ".")).alias("package"),
        F.when((lang == "go") & head.startswith("func ( )"), F.regexp_extract(F.try_element_at(F.filter("code", lambda t: t["kind"] == "("), F.lit(1))["text"], r"([\w]+)\s*(?:\[.*\])?\s*$", 1)).alias("receiver"),
    )
    # Declarations are few; they are written, as the file's scopes and its functions both come from them.
    kept = scratch.save(islands.where(F.coalesce("klass", "named", "member", "arrow", "package", "rel_path").isNotNull()).drop("code"))
    scopes = F.array_sort(F.collect_list(F.when(F.col("is_open"), F.struct("open", "close", F.coalesce("klass", "named", "arrow", "member").alias("name"), F.col("klass").isNotNull().alias("is_class")))))
    per_file = kept.groupBy("rid").agg(scopes.alias("scopes"), F.max("package").alias("pkg"), F.max("rel_path").alias("rel_path"))
    found = kept.drop("rel_path").where(F.col("klass").isNull() & F.coalesce("named", "member", "arrow").isNotNull()).join(per_file, "rid")
    around = F.filter("scopes", lambda s: (s["open"] < F.col("open")) & (F.coalesce(s["close"], F.lit(2147483647)) > F.col("open")))
    found = found.withColumn("around", around).withColumn("in_class", F.coalesce(F.try_element_at(F.col("around"), F.lit(-1))["is_class"], F.lit(False)))
    owner = F.try_element_at(F.col("around"), F.lit(-1))["name"]
    typed = F.regexp_replace("head", modifiers, "")
    found = found.withColumn(
        "name",
        F.when(F.col("language") == "java", F.when(F.col("in_class") & (~typed.rlike(r"^[\w$]+ \( \)") | (F.col("named") == owner)), F.col("named")))
        .when(F.col("language").isin("python", "go"), F.when((F.col("language") == "python") | (F.size("around") == 0), F.col("named")))
        .otherwise(F.coalesce(F.col("named"), F.col("arrow"), F.when(F.col("in_class"), F.col("member")))),
    ).where("name is not null and (is_open or language <> 'python')")
    found = found.where(F.col("is_open") | F.col("in_class") | F.col("arrow").isNotNull() | (F.col("language") == "go"))
    prefix = F.when(F.col("language") == "java", F.col("pkg")).otherwise(F.translate(F.regexp_replace("rel_path", r"\.[^./]*$", ""), "/", "."))
    path = F.concat(F.array(F.nullif(prefix, F.lit(""))), F.array(F.col("receiver")), F.transform("around", lambda s: s["name"]), F.array("name"))
    words = F.filter("toks", lambda t: t["kind"].isin("ID", "WORD"))
    at = F.filter(words, lambda t: t["text"] == F.col("name"))
    # The name is the last such word before the parameter list; a modifier can never equal it.
    at = F.try_element_at(at, F.when(F.col("language") == "go", 1).when(F.col("arrow").isNotNull(), 1).otherwise(-1))
    opened = F.try_element_at(F.filter("toks", lambda t: (t["kind"] == "(") & (t["pos"] > at["pos"])), F.lit(1))
    found = found.withColumn("at", at).withColumn("params", F.coalesce(opened["text"], F.lit("")))
    notes = F.filter("toks", lambda t: (t["kind"] == "CMT") & (t["pos"] < F.col("at")["pos"]))
    first_code = F.try_element_at(F.filter("toks", lambda t: t["kind"] != "CMT"), F.lit(1))["line"]
    # In Go the block of comments whose last one ends right above the declaration.
    last_one = F.try_element_at(notes, F.lit(-1))
    chain = F.when(last_one["end_line"] == first_code - 1, F.transform(F.filter(notes, lambda t: t["block"] == last_one["block"]), lambda t: t["text"]))
    last_note = last_one["text"]
    doc = F.when(F.col("language") == "python", F.col("docstring")).when(F.col("language") == "go", F.nullif(F.array_join(chain, "\n"), F.lit(""))).otherwise(F.when(last_note.rlike(r"^/\*\*[^/]"), last_note))
    return found.select(
        "rel_path", "language", F.array_join(path, ".").alias("qualified_name"), "name", "params", F.col("at.line").alias("start_line"), "end_line",
        F.when(F.col("language") == "python", "string").when(F.col("language") == "go", "lines").otherwise("block").alias("style"), doc.alias("doc"),
    ).distinct()


def function_documentation(files: DataFrame) -> DataFrame:
    """Functions with real documentation: rel_path, language, qualified_name, params, start_line, end_line, documentation.

    files: rel_path, source_project, content. Files that do not parse, null and empty contents give no rows. The
    documentation is the text without comment signs and markup; see `doc_text` for what counts as none.
    """
    declared = function_declarations(files).where("doc is not null")
    cleaned = declared.withColumn("documentation", real_documentation("doc", "qualified_name", "style"))
    return cleaned.where("documentation <> ''").select("rel_path", "language", "qualified_name", "params", "start_line", "end_line", "documentation")
