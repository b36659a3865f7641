"""Source text to raw facts: symbols, imports, heritage and calls, one row each."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import language_of
from skein.syntax.lexers import Token, lex

FACTS = "file_path string, language string, fact string, name string, qualified_name string, line int, end_line int, parent string, detail string"


def _package(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path).replace("/", ".")


def python_facts(path: str, text: str) -> list[tuple]:
    """Facts of a Python module through the standard parser; a module that does not parse has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []
    stack: list[tuple[ast.AST, str]] = [(tree, _package(path))]
    while stack:
        node, scope = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{scope}.{child.name}"
                args = [a.arg for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs)]
                rows.append(("function", child.name, inner, child.lineno, child.end_lineno, scope, ",".join(args)))
            elif isinstance(child, ast.ClassDef):
                inner = f"{scope}.{child.name}"
                rows.append(("class", child.name, inner, child.lineno, child.end_lineno, scope, ""))
                rows += [("extends", child.name, inner, child.lineno, child.lineno, ast.unparse(b), "") for b in child.bases]
            elif isinstance(child, ast.Import):
                rows += [("import", a.name, a.asname or a.name, child.lineno, child.lineno, a.name, "") for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                rows += [("import", a.name, a.asname or a.name, child.lineno, child.lineno, module, "*" if a.name == "*" else "") for a in child.names]
            elif isinstance(child, ast.Call):
                f = child.func
                called = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""
                if called:
                    rows.append(("call", called, scope, child.lineno, child.end_lineno, ast.unparse(f.value) if isinstance(f, ast.Attribute) else "", str(len(child.args) + len(child.keywords))))
            stack.append((child, inner))
    return rows


# Words before ( that are no calls.
_NO_CALL = set("if for while switch catch return func function synchronized super new throw else do try select go defer typeof in of await yield case assert constructor range".split())
# What an import clause is made of.
_IMPORT = {"ID", "STR", *"{ } , * . = ( static as from type typeof require _".split()}


def brace_facts(language: str, path: str, text: str) -> list[tuple]:
    """Facts of a Java, Go, JavaScript or TypeScript file by one pass over its tokens, with a stack of open scopes."""
    tokens = [t for t in lex(language, text).tokens if t.kind != "NL"]
    word = lambda i: text[tokens[i].start : tokens[i].end] if 0 <= i < len(tokens) else ""
    kind = lambda i: tokens[i].kind if 0 <= i < len(tokens) else ""
    close: dict[int, int] = {}
    opened: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind in ("(", "{", "["):
            opened.append(i)
        elif t.kind in (")", "}", "]") and opened:
            close[opened.pop()] = i
    package = _package(path)
    rows: list[tuple] = []
    scopes: list[tuple[int, str, str]] = []  # index of the closing brace, name, kind
    named: dict[int, tuple[str, str]] = {}  # opening brace -> scope

    def dotted(i: int) -> tuple[str, int]:
        parts = [word(i)]
        while kind(i + 1) == "." and (word(i + 2).isidentifier() or kind(i + 2) == "*"):
            parts.append(word(i + 2))
            i += 2
        return ".".join(parts), i

    def scope() -> str:
        return ".".join([package, *[n for _, n, _ in scopes]])

    def count(o: int) -> int:
        e = close.get(o, o)
        if e <= o + 1:
            return 0
        n, j = 1, o + 1
        while j < e:
            if j in close:
                j = close[j]
            elif kind(j) == ",":
                n += 1
            j += 1
        return n

    i, n = 0, len(tokens)
    while i < n:
        while scopes and i > scopes[-1][0]:
            scopes.pop()
        t: Token = tokens[i]
        k = t.kind
        if k == "{" and i in named:
            name, what = named[i]
            scopes.append((close.get(i, n), name, what))
        elif k == "package" and language == "java" and not scopes:
            package, i = dotted(i + 1)
        elif k == "import" and kind(i + 1) != "(" and not (kind(i + 1) == "." and language in ("javascript", "typescript")):
            j, braced = i + 1, 0
            names, module = [], ""
            # To the module string or the end of the clause: any word may stand in its braces, few outside.
            while j < braced or kind(j) in _IMPORT or word(j) in _IMPORT:
                if kind(j) == "STR":
                    module = word(j).strip("\"'`")
                    break
                if kind(j) == "ID":
                    names.append(word(j))
                if kind(j) == "{":
                    braced = max(braced, close.get(j, 0))
                j += 1
            if language == "java":
                module, _ = dotted(i + 2 if kind(i + 1) == "static" else i + 1)
                names = [module.rsplit(".", 1)[-1]]
            rows += [("import", x, x, t.line, t.line, module, "") for x in names or [module.rsplit("/", 1)[-1]]]
            i = j if kind(j) in ("STR", ";") else j - 1
        elif k == "import":
            for j in range(i + 2, close.get(i + 1, i + 1)):
                if kind(j) == "STR":
                    m = word(j).strip('"`')
                    rows.append(("import", m.rsplit("/", 1)[-1], m, tokens[j].line, tokens[j].line, m, ""))
            i = close.get(i + 1, i + 1)
        elif (k in ("class", "interface", "enum") and kind(i - 1) != "." or language == "go" and k == "type") and kind(i + 1) == "ID":
            name, j = word(i + 1), i + 2
            while kind(j) not in ("", "{", ";"):
                if kind(j) in ("extends", "implements"):
                    what = kind(j)
                    j += 1
                    while kind(j) not in ("", "{", "extends", "implements"):
                        if kind(j) == "ID" and kind(j - 1) in ("extends", "implements", ","):
                            rows.append((what, name, f"{scope()}.{name}", tokens[j].line, tokens[j].line, dotted(j)[0], ""))
                        j += 1
                    continue
                j += 1
            if kind(j) == "{" and (language != "go" or kind(j - 1) in ("struct", "interface")):
                named[j] = (name, "class")
                end = tokens[close.get(j, n - 1)].line
                rows.append(("class", name, f"{scope()}.{name}", tokens[i + 1].line, end, scope(), kind(j - 1) if language == "go" else k))
                if language == "go" and kind(j - 1) == "struct":
                    for m in range(j + 1, close.get(j, j)):
                        if kind(m) == "ID" and kind(m + 1) == ";" and kind(m - 1) in ("{", ";", "*"):
                            rows.append(("embedding", name, f"{scope()}.{name}", tokens[m].line, tokens[m].line, word(m), ""))
        elif k == "(" and (kind(i - 1) == "ID" or word(i - 1).isidentifier() and word(i - 1) not in _NO_CALL) or k == "(" and word(i - 1) == "constructor":
            name, e = word(i - 1), close.get(i, n - 1)
            j = e + 1
            while kind(j) in ("throws", "ID", ".", ",", ":", "<", ">", "[", "]", "*", "|", "void", "string", "number", "boolean", "any", "error") and kind(j) != "":
                j += 1
            if language == "go" and kind(j) == "(":
                j = close.get(j, j) + 1
            before = kind(i - 2)
            in_class = bool(scopes) and scopes[-1][2] == "class"
            declared = kind(j) == "{" and (before == "func" or before == ")" and language == "go" or before == "function" or in_class and language != "go" and before not in (".", "new", "return", "="))
            if declared:
                owner = ""
                if language == "go" and before == ")":
                    o = next((a for a, b in close.items() if b == i - 2), -1)
                    if kind(o - 1) == "func":
                        ids = [word(m) for m in range(o + 1, i - 2) if kind(m) == "ID"]
                        owner = ids[-1] + "." if ids else ""
                named[j] = (owner + name, "function")
                rows.append(("function", name, f"{scope()}.{owner}{name}", tokens[i - 1].line, tokens[close.get(j, n - 1)].line, scope(), str(count(i))))
            elif kind(i - 1) == "ID" and before not in ("func", "function", "class", "@") and not (in_class and kind(j) in ("{", ";") and before != "="):
                receiver = ""
                if before in (".", "?."):
                    a = i - 3
                    while kind(a) in ("ID", ".", "this", "super"):
                        a -= 1
                    receiver = text[tokens[a + 1].start : tokens[i - 2].start] if a + 1 < i - 2 else ""
                rows.append(("call", name, scope(), tokens[i - 1].line, tokens[e].line, receiver, str(count(i))))
        elif language in ("javascript", "typescript") and k == "=>" and kind(i + 1) == "{" and not scopes:
            a = i - 1
            while a > 0 and kind(a) not in ("=", ";", "{", "}"):
                a -= 1
            if kind(a) == "=" and kind(a - 1) == "ID" or kind(a) == "=" and ":" in [kind(b) for b in range(max(0, a - 6), a)]:
                b = a - 1
                while b > 0 and kind(b - 1) not in ("const", "let", "var", ";", "}"):
                    b -= 1
                name = word(b)
                named[i + 1] = (name, "function")
                rows.append(("function", name, f"{scope()}.{name}", tokens[b].line, tokens[close.get(i + 1, n - 1)].line, scope(), "arrow"))
        i += 1
    return rows


def file_facts(files: DataFrame) -> DataFrame:
    """Facts of all files: file_path, language, fact (function, class, extends, implements, embedding, import, call),
    name, qualified_name (of the symbol; for calls of the caller's scope), line, end_line, parent (scope, super type,
    module or receiver), detail (parameters or argument count).

    files: rel_path, content. Repeated files repeat their facts; null content and unknown extensions give none. Faults in
    brace languages do not stop the scan: what is there is reported.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_path", "language", "fact", "name", "qualified_name", "line", "end_line", "parent", "detail"]
        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf.rel_path, pdf.language, pdf.content):
                text = bytes(content).decode("utf-8-sig", "replace")
                found = python_facts(path, text) if language == "python" else brace_facts(language, path, text)
                rows += [(path, language, *r) for r in found]
            yield pd.DataFrame(rows, columns=columns)

    known = files.where("content is not null and rel_path is not null").select("rel_path", language_of(F.col("rel_path")).alias("language"), "content").where("language <> ''")
    return known.mapInPandas(run, FACTS)
