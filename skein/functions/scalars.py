"""Scalar functions as column expressions: URLs, SQL text, names, types, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_params(path: Column) -> Column:
    """Every segment that holds {..}, :name, <..>, [..] or is all digits becomes {param}."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"\{[^}]*\}|:[A-Za-z_]\w*|<[^>]*>|\[[^\]]*\]|^\d+$"), F.lit("{param}")).otherwise(s)), "/")


def _url_text(url: Column) -> Column:
    return F.btrim(F.trim(url), F.lit("`"))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def url_service(url: Column) -> Column:
    """Host of a URL with a scheme; '' without one and for local hosts."""
    host = F.regexp_extract(_url_text(url), _SCHEME + r"([^/:?#]*)", 1)
    return F.when(host.isin("localhost", "127.0.0.1", "0.0.0.0"), "").otherwise(host)


def url_path(url: Column) -> Column:
    """Normalised path: query dropped, leading /, parameters replaced; '' for empty and concatenated texts. A fragment
    is dropped only behind a scheme, and a scheme without a path leaves the whole text as path."""
    t = _url_text(url)
    inner = F.regexp_extract(t, _SCHEME + r"[^/?#]*([^?#]*)", 1)
    path = F.when(t.rlike(_SCHEME), F.when(inner == "", t).otherwise(inner)).otherwise(F.substring_index(t, "?", 1))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when((t == "") | path.contains("+") | path.contains("concat"), "").otherwise(path_params(path))


def query_type(sql: Column) -> Column:
    u = F.upper(F.trim(sql))
    return F.when(u.startswith("SELECT") | u.startswith("FROM"), "SELECT").when(u.startswith("INSERT"), "INSERT").when(u.startswith("UPDATE"), "UPDATE").when(u.startswith("DELETE"), "DELETE").otherwise("UNKNOWN")


def sql_tables(sql: Column) -> Column:
    """Target of a leading UPDATE, then the first table behind FROM, INTO and JOIN each."""
    s = F.concat(F.lit(" "), F.trim(sql), F.lit(" "))
    names = [F.regexp_extract(F.trim(sql), r"(?i)^update\s+([^\s,();]+)", 1)] + [F.regexp_extract(s, rf"(?i) {k} +([^\s,();]+)", 1) for k in ("from", "into", "join")]
    return F.filter(F.array(*names), lambda x: x != "")


def is_sql_statement(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(r"^(SELECT|INSERT|UPDATE|DELETE) ")


def clean_sql(sql: Column) -> Column:
    return F.regexp_replace(F.trim(sql), r"\s+", " ")


def route_path(path: Column) -> Column:
    p = F.trim(path)
    return F.lower(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def route_role(framework: Column) -> Column:
    return F.when(framework == "feign", "consumer").otherwise("provider")


def proto_service(name: Column) -> Column:
    """Service name in the names of generated clients, servers and stubs; '' if there is none."""
    patterns = [r"^New(.+)Client$", r"^Register(.+)Server$", r"^(.+)Stub$", r"^add_(.+)Servicer_to_server$", r"^(.+)Grpc$"]
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def rpc_method(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000))


def derive_package(path: Column) -> Column:
    """Dotted package of a file path, without the extension of a TypeScript, JavaScript or Python file and without a last
    /index or /__init__; one of these alone stays."""
    base = path
    for ext in (".ts", ".tsx", ".js", ".jsx", ".py"):
        base = F.regexp_replace(base, ext.replace(".", r"\.") + "$", "")
    return F.translate(F.regexp_replace(F.regexp_replace(F.translate(base, "\\", "/"), "/index$", ""), "/__init__$", ""), "/", ".")


def symbol_id(file_path: Column, qualified_name: Column, start_line: Column) -> Column:
    """First 16 hex digits of the SHA-256 of file:name:line."""
    return F.substring(F.sha2(F.concat_ws(":", file_path, qualified_name, start_line.cast("string")), 256), 1, 16)


def strip_nullable(name: Column) -> Column:
    """X of Optional[X]; the one member of a union besides the null-like ones; '' if none is left; else unchanged."""
    members = F.filter(F.transform(F.split(name, r"\|"), lambda x: F.trim(x)), lambda x: ~x.isin("null", "undefined", "None", "void", ""))
    optional = F.regexp_extract(F.trim(name), r"^Optional\[(.*)\]$", 1)
    return F.when(optional != "", optional).when(F.size(members) == 1, members[0]).when(F.size(members) == 0, "").otherwise(name)


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def owner_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def constructor_type(called: Column) -> Column:
    """NewX -> X; a capitalised name of more than three letters is its own type; else ''."""
    fresh = F.regexp_extract(called, r"^New([A-Z]\w*)$", 1)
    return F.when(fresh != "", fresh).when(called.rlike(r"^[A-Z]") & (F.length(called) > 3), called).otherwise("")


def simple_identifier(text: Column) -> Column:
    return text.rlike(r"^[^\d.() \"'+\-][^.() \"'+\-]*$")


def enum_constant(text: Column) -> Column:
    """An upper-case first letter, then behind the first dot anything without small letters."""
    return text.rlike(r"^[A-Z][^.]*\.[^a-z]+$")


def annotation_base(text: Column) -> Column:
    """Name of an annotation without @ and arguments; of three or more segments only the last."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^@", ""), r"\([\s\S]*$", "")
    return F.when(F.size(F.split(bare, r"\.")) >= 3, F.substring_index(bare, ".", -1)).otherwise(bare)


def annotation_params(text: Column) -> Column:
    return F.regexp_extract(text, r"\(([\s\S]*)\)", 1)


def memory_limit(text: Column) -> Column:
    """Bytes of texts such as 4GB or 1.5 MB; the greatest long for '' and 0 (no limit); null if unreadable."""
    t = F.upper(F.trim(text))
    unit = F.regexp_extract(t, r"(GB|MB|KB|B)?$", 1)
    number = F.trim(F.regexp_replace(t, r"(GB|MB|KB|B)$", "")).try_cast("double")
    scale = F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1)
    return F.when(t.isin("", "0"), (1 << 63) - 1).otherwise((number * scale).cast("long"))


def flow_parts(context: Column) -> Column:
    return F.split(context, " - ")


def params_summary(params: Column) -> Column:
    """(T1, T2) of a JSON parameter list."""
    parsed = F.from_json(params, "array<struct<name:string,type:string,has_default:boolean>>")
    return F.concat(F.lit("("), F.coalesce(F.array_join(F.transform(parsed, lambda p: F.coalesce(p["type"], F.lit(""))), ", "), F.lit("")), F.lit(")"))


def segments_match(a: Column, b: Column) -> Column:
    """Segment-wise equality of paths of equal length, {..} matching anything on either side."""
    wild = lambda s: s.rlike(r"^\{.*\}$")
    x, y = F.filter(F.split(a, "/"), lambda s: s != ""), F.filter(F.split(b, "/"), lambda s: s != "")
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: (p == q) | wild(p) | wild(q)), lambda ok: ok)


# File conventions.
EXTENSIONS = {"java": "java", "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
TEST_DIRECTORIES = ("test", "tests", "__tests__", "spec", "specs", "__mocks__")
IGNORED_DIRECTORIES = (
    "node_modules", ".git", "__pycache__", "vendor", "dist", "build", ".gradle", ".idea", ".vscode", ".fcg", "target", ".next", ".nuxt", "out", "bin", "obj", ".cache", "coverage", ".tox", ".mypy_cache",
    ".pytest_cache", "venv", ".venv",
)
TEST_NAMES = {"go": r"_test\.go$", "java": r"(Test|Tests|Spec)(\.java)?$", "python": r"^test_|_test(\.py)?$", "typescript": r"\.(test|spec)\.[tj]sx?$", "javascript": r"\.(test|spec)\.[tj]sx?$"}
SQL_KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "WITH", "FROM", "WHERE", "JOIN", "SET", "INTO", "VALUES")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])[ext], F.lit(""))


def is_test_file(path: Column) -> Column:
    """Whether the name is that of a test in the language of its extension."""
    name, language = F.substring_index(path, "/", -1), language_of(path)
    out = F.lit(False)
    for key, pattern in TEST_NAMES.items():
        out = F.when(language == key, name.rlike(pattern)).otherwise(out)
    return out


def in_segments(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def in_test_directory(path: Column) -> Column:
    """Whether a file lies in a test directory; for Java, and where the language is unknown, also below src/test."""
    return in_segments(path, TEST_DIRECTORIES) | language_of(path).isin("java", "") & F.regexp_replace(path, r"[^/]*$", "").contains("src/test/")


def in_ignored_directory(path: Column, rules: tuple[str, ...] = ()) -> Column:
    return in_segments(path, IGNORED_DIRECTORIES + rules)


def definition_category(extension: Column, queries: tuple[str, ...], schemas: tuple[str, ...]) -> Column:
    """query_def or schema_def by extension, '' for others; the first takes precedence."""
    return F.when(extension.isin(*queries), "query_def").when(extension.isin(*schemas), "schema_def").otherwise("")


def grpc_target(target: Column) -> Column:
    """Host of a gRPC target: without scheme (text up to :///) and port."""
    bare = F.when(target.contains(":///"), F.substring_index(target, ":///", -1)).otherwise(target)
    return F.substring_index(bare, ":", 1)


def is_sql_stub(text: Column) -> Column:
    """Whether a text holds an SQL keyword anywhere, in any case."""
    return F.upper(text).rlike("|".join(SQL_KEYWORDS))


def grpc_invoke(path: Column) -> Column:
    """(service, method) of /Service/Method; empty texts without a second part."""
    bare = F.regexp_replace(path, "^/", "")
    return F.when(bare.contains("/"), F.struct(F.substring_index(bare, "/", 1).alias("service"), F.regexp_replace(bare, "^[^/]*/", "").alias("method"))).otherwise(F.struct(F.lit("").alias("service"), F.lit("").alias("method")))


def scoped_key(scope: Column, name: Column) -> Column:
    """scope:name, or the name alone where there is no scope."""
    return F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat(scope, F.lit(":"), name))


def owner_outside_parens(text: Column) -> Column:
    """The text before its last dot outside parentheses, '' without one; one pass from the right with the depth."""
    def close(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == ")", 1).when(c == "(", -1).otherwise(0)
        hit = (c == ".") & (acc["depth"] == 0) & (acc["at"] < 0)
        return F.struct((acc["i"] + 1).alias("i"), depth.alias("depth"), F.when(hit, acc["i"]).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("at"))
    at = F.aggregate(F.split(F.reverse(text), ""), start, close)["at"]
    return F.when(at >= 0, F.substring(text, F.lit(1), F.length(text) - at - 1)).otherwise("")


def multi_values(text: Column) -> Column:
    """Values of an annotation argument: {"/a", "/b"} or one value; an empty text is one empty value."""
    bare = F.regexp_replace(F.trim(text), r"^\{([\s\S]*)\}$", "$1")
    return F.when(F.trim(text) == "", F.array(F.lit(""))).otherwise(F.transform(F.split(bare, ","), lambda x: F.btrim(F.trim(x), F.lit('"'))))


def request_methods(text: Column) -> Column:
    """HTTP verbs of RequestMethod.X values, in order; others are left out."""
    verb = lambda x: F.regexp_extract(x, r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)", 1)
    return F.filter(F.transform(multi_values(text), verb), lambda x: x != "")


def annotation_value(text: Column) -> Column:
    """First quoted text among an annotation's arguments, else the bare value; '' without arguments."""
    inner = F.trim(F.regexp_extract(text, r"^[^(]*\(([\s\S]*)\)", 1))
    inner = F.regexp_replace(inner, r"^(value|path)\s*=\s*", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"^\{", ""), r"\}$", "")
    quoted = F.regexp_extract(inner, r'^[^"]*"([^"]*)"', 1)
    return F.when(inner.rlike(r'^[^"]*"[^"]*"'), quoted).otherwise(F.btrim(inner, F.lit("\"'")))


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\S*)", 1)


def first_quoted(text: Column) -> Column:
    return F.regexp_extract(text, r"""["']([^"']*)["']""", 1)


def route_of_annotations(names: Column, values: Column) -> Column:
    """(verb, path) of the first mapping annotation among parallel arrays of names and first values; both '' if none."""
    verbs = F.create_map(*[x for k in ("Get", "Post", "Put", "Delete", "Patch") for x in (F.lit(k + "Mapping"), F.lit(k.upper()))])
    hits = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: verbs[x["n"]].isNotNull())
    hit = F.try_element_at(hits, F.lit(1))
    return F.struct(F.coalesce(verbs[hit["n"]], F.lit("")).alias("method"), F.coalesce(hit["v"], F.lit("")).alias("path"))


def staleness_message(reason: Column, last: Column, current: Column, added: Column, modified: Column, deleted: Column) -> Column:
    """Warning text of a stale index; '' for other reasons."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    parts = F.array_join(F.array_compact(F.array(part(added, "added"), part(modified, "modified"), part(deleted, "deleted"))), ", ")
    return (
        F.when(reason == "not_indexed", "Index not found. Run index_repository to build the index.")
        .when(reason == "new_commits", F.format_string("Index outdated: branch has new commits (indexed: %s, current: %s). Consider re-indexing.", F.substring(last, 1, 7), F.substring(current, 1, 7)))
        .when(reason == "files_changed", F.concat(F.lit("Index outdated: "), parts, F.lit(" since last index. Consider re-indexing.")))
        .otherwise("")
    )


def is_getter(name: Column, is_static: Column, n_params: Column, n_returns: Column, complexity: Column, lines: Column) -> Column:
    """get.. or is.. of more than three letters without parameters, with a result, one branch and one line of body (lines:
    last line less first)."""
    return ~is_static & (n_params == 0) & (n_returns > 0) & name.rlike("^(get|is)") & (F.length(name) > 3) & (complexity <= 1) & (lines - 1 <= 1)


def is_setter(name: Column, is_static: Column, n_params: Column, returns_nothing: Column, complexity: Column, lines: Column) -> Column:
    return ~is_static & (n_params == 1) & name.startswith("set") & (F.length(name) > 3) & returns_nothing & (complexity <= 1) & (lines - 1 <= 1)


def is_catch_all(segment: Column) -> Column:
    """**, *, [...x] and [[...x]] stand for all further segments."""
    return segment.isin("**", "*") | segment.startswith("[...") | segment.startswith("[[...")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def accepts_arguments(params: Column, n_arguments: Column) -> Column:
    """Whether a parameter list (array of structs with type and has_default) takes so many arguments: all but the last
    of a variadic one, else from the required to all."""
    n, last = F.size(params), F.try_element_at(params, F.lit(-1))
    required = F.size(F.filter(params, lambda p: ~F.coalesce(p["has_default"], F.lit(False))))
    return F.when((n > 0) & F.coalesce(last["type"], F.lit("")).endswith("..."), n_arguments >= n - 1).otherwise(n_arguments.between(required, n))


def in_owner(qualified_name: Column, owner: Column) -> Column:
    """Whether a name lies in a class: it holds .Owner. or begins with Owner.; a pointer sign before the owner is dropped."""
    bare = F.regexp_replace(owner, r"^\*", "")
    return qualified_name.contains(F.concat(F.lit("."), bare, F.lit("."))) | qualified_name.startswith(F.concat(bare, F.lit(".")))


def matches_import(qualified_name: Column, module: Column) -> Column:
    return (qualified_name == module) | qualified_name.startswith(F.concat(module, F.lit(".")))
