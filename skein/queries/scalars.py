"""Scalar functions over whole columns; each against the same rule written for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.lens import view, with_views
from skein.storage import read_table

_SEG = "list_aggregate(list_transform(string_split({p}, '/'), lambda s: case when regexp_matches(s, '\\{{[^}}]*\\}}|:[A-Za-z_]\\w*|<[^>]*>|\\[[^\\]]*\\]|^\\d+$') then '{{param}}' else s end), 'string_agg', '/')"
_T = "trim(trim(s), '`')"
_SCH = "^[A-Za-z][A-Za-z0-9+.\\-]*://"
_RAW = f"case when regexp_matches({_T}, '{_SCH}') then case when regexp_extract({_T}, '{_SCH}[^/?#]*([^?#]*)', 1) = '' then {_T} else regexp_extract({_T}, '{_SCH}[^/?#]*([^?#]*)', 1) end else string_split({_T}, '?')[1] end"
_ABS = f"case when starts_with({_RAW}, '/') then {_RAW} else '/' || {_RAW} end"
_EXTS = " ".join(f"when '{k}' then '{v}'" for k, v in S.EXTENSIONS.items())

# key: (view or table, id column, text column, Spark function, SQL over s)
ROWS = {
    "x01_url_path": ("url", "id", "s", S.url_path, f"case when {_T} = '' or contains({_ABS}, '+') or contains({_ABS}, 'concat') then '' else {_SEG.format(p=_ABS)} end"),
    "x01_url_service": ("url", "id", "s", S.url_service, f"case when regexp_extract({_T}, '{_SCH}([^/:?#]*)', 1) in ('localhost', '127.0.0.1', '0.0.0.0') then '' else regexp_extract({_T}, '{_SCH}([^/:?#]*)', 1) end"),
    "x02_path_params": ("route", "id", "path", S.path_params, _SEG.format(p="s")),
    "x03_query_type": ("query_node", "id", "sql_text", S.query_type, "case when regexp_matches(upper(trim(s)), '^(SELECT|FROM)') then 'SELECT' when regexp_matches(upper(trim(s)), '^(INSERT|UPDATE|DELETE)') then upper(trim(s))[1:6] else 'UNKNOWN' end"),
    "x04_tables": ("query_node", "id", "sql_text", lambda c: F.array_join(S.sql_tables(c), ","), "array_to_string(list_filter([regexp_extract(trim(s), '(?i)^update\\s+([^\\s,();]+)', 1), regexp_extract(' ' || trim(s) || ' ', '(?i) from +([^\\s,();]+)', 1), regexp_extract(' ' || trim(s) || ' ', '(?i) into +([^\\s,();]+)', 1), regexp_extract(' ' || trim(s) || ' ', '(?i) join +([^\\s,();]+)', 1)], lambda x: x <> ''), ',')"),
    "x05_is_sql": ("query_node", "id", "sql_text", S.is_sql_statement, "regexp_matches(upper(trim(s)), '^(SELECT|INSERT|UPDATE|DELETE) ')"),
    "x07_clean_sql": ("query_node", "id", "sql_text", S.clean_sql, "regexp_replace(trim(s), '\\s+', ' ', 'g')"),
    "x09_route_path": ("route", "id", "path", S.route_path, "lower(case when starts_with(trim(s), '/') then trim(s) else '/' || trim(s) end)"),
    "x10_route_role": ("route", "id", "framework", S.route_role, "case when s = 'feign' then 'consumer' else 'provider' end"),
    "x11_proto_service": ("type_text", "id", "s", S.proto_service, "case when starts_with(s, 'New') and ends_with(s, 'Client') and length(s) > 9 then s[4:-7] when starts_with(s, 'Register') and ends_with(s, 'Server') and length(s) > 14 then s[9:-7] when ends_with(s, 'Stub') and length(s) > 4 then s[:-5] when ends_with(s, 'Grpc') and length(s) > 4 then s[:-5] else '' end"),
    "x12_rpc_method": ("fn", "id", "name", S.rpc_method, "lower(s[1:1]) || s[2:]"),
    "x15_package": ("files", "rel_path", "rel_path", S.derive_package, "replace(case when regexp_matches(b, '/(index|__init__)$') then b[: -(2 + length(string_split(b, '/')[-1]))] else b end, '/', '.')"),
    "x19_strip_nullable": ("type_text", "id", "s", S.strip_nullable, "case s when 'Optional[A]' then 'A' when 'A | null' then 'A' when 'None' then '' else s end"),
    "x23_simple_name": ("fn", "id", "qualified_name", S.simple_name, "string_split(s, '.')[-1]"),
    "x26_last_segment": ("fn", "id", "qualified_name", S.simple_name, "regexp_extract(s, '[^.]*$')"),
    "x25_identifier": ("calls", "call_id", "receiver_expr", S.simple_identifier, "regexp_matches(s, '^[^\\d.() \"''+\\-][^.() \"''+\\-]*$')"),
    "x27_constructor_type": ("calls", "call_id", "called_name", S.constructor_type, "case when regexp_matches(s, '^New[A-Z]\\w*$') then s[4:] when regexp_matches(s, '^[A-Z]') and length(s) > 3 then s else '' end"),
    "f37_enum_constant": ("calls", "call_id", "receiver_expr", S.enum_constant, "case when s is null then null when contains(s, '.') and instr(s, '.') > 1 and instr(s, '.') < length(s) then ascii(s) between 65 and 90 and not regexp_matches(s[instr(s, '.') + 1:], '[a-z]') else false end"),
    "x36_flow_parts": ("call_edge", "edge_id", "flow_context", lambda c: F.coalesce(F.size(S.flow_parts(c)), F.lit(0)), "coalesce(len(string_split(s, ' - ')), 0)"),
    "x37_params_summary": ("fn", "id", "params", S.params_summary, "'(' || case when coalesce(s, '') = '' then '' else coalesce(array_to_string(list_transform(cast(json_extract_string(s, '$[*].type') as varchar[]), lambda x: coalesce(x, '')), ', '), '') end || ')'"),
    "x13_grpc_target": ("url", "id", "s", S.grpc_target, "string_split(case when contains(s, ':///') then string_split(s, ':///')[-1] else s end, ':')[1]"),
    "x06_sql_stub": ("query_node", "id", "sql_text", S.is_sql_stub, "list_bool_or([contains(upper(s), k) for k in " + str(list(S.SQL_KEYWORDS)) + "])"),
    "s03_language": ("files", "rel_path", "rel_path", S.language_of, f"case lower(regexp_extract(s, '\\.([^./]+)$', 1)) {_EXTS} else '' end"),
    "s04_test_file": ("files", "rel_path", "rel_path", S.is_test_file, "case regexp_extract(s, '\\.([^./]+)$', 1) when 'go' then ends_with(s, '_test.go') when 'java' then ends_with(s, 'Test.java') or ends_with(s, 'Tests.java') or ends_with(s, 'Spec.java') when 'py' then starts_with(string_split(s, '/')[-1], 'test_') or ends_with(s, '_test.py') else ends_with(s, '.test.ts') or ends_with(s, '.test.js') or ends_with(s, '.spec.ts') or ends_with(s, '.spec.js') end"),
    "s05_test_directory": ("files", "rel_path", "rel_path", S.in_test_directory, f"list_has_any(string_split(s, '/')[:-2], {list(S.TEST_DIRECTORIES)}) or (ends_with(s, '.java') and contains(s, 'src/test/'))"),
    "s06_ignored_directory": ("files", "rel_path", "rel_path", S.in_ignored_directory, f"list_has_any(string_split(s, '/')[:-2], {list(S.IGNORED_DIRECTORIES)})"),
    "s07_definition_category": ("files", "rel_path", "rel_path", lambda c: S.definition_category(F.regexp_extract(c, r"(\.[^./]+)$", 1), (".xml", ".go"), (".proto", ".graphql", ".ts")), "case when ends_with(s, '.xml') or ends_with(s, '.go') then 'query_def' when ends_with(s, '.ts') then 'schema_def' else '' end"),
    "x08_segments": ("url", "id", "s", lambda c: F.array_join(S.segments(c), "|"), "array_to_string(list_filter(string_split(s, '/'), lambda x: x <> ''), '|')"),
    "x08_catch_all": ("route", "id", "path", lambda c: S.is_catch_all(F.coalesce(F.try_element_at(S.segments(c), F.lit(-1)), F.lit(""))), "coalesce(list_filter(string_split(s, '/'), lambda x: x <> '')[-1], '') in ('**', '*') or starts_with(coalesce(list_filter(string_split(s, '/'), lambda x: x <> '')[-1], ''), '[...')"),
    "x14_grpc_invoke": ("url", "id", "s", lambda c: F.concat_ws("|", S.grpc_invoke(c)["service"], S.grpc_invoke(c)["method"]), "case when contains(ltrim(s[1:1], '/') || s[2:], '/') then string_split(ltrim(s[1:1], '/') || s[2:], '/')[1] || '|' || array_to_string(string_split(ltrim(s[1:1], '/') || s[2:], '/')[2:], '/') else '|' end"),
    "x20_annotation_base": ("calls", "call_id", "receiver_expr", S.annotation_base, "case when length(b) - length(replace(b, '.', '')) >= 2 then string_split(b, '.')[-1] else b end"),
    "x24_owner_outside_parens": ("calls", "call_id", "receiver_expr", S.owner_outside_parens, "case when o > 0 then s[: length(s) - o] else '' end"),
    "x28_scoped_key": ("calls", "call_id", "receiver_expr", lambda c: S.scoped_key(F.substring_index(c, ".", 1), c), "case when string_split(s, '.')[1] = '' then s else string_split(s, '.')[1] || ':' || s end"),
    "x38_first_word": ("query_node", "id", "sql_text", S.first_word, "regexp_extract(trim(s), '^[^ ]*')"),
    "x39_multi_values": ("calls", "call_id", "receiver_expr", lambda c: F.array_join(S.multi_values(F.concat(F.lit("{"), c, F.lit(', "/b"}'))), "|"), "array_to_string(list_transform(string_split(s || ', \"/b\"', ','), lambda x: trim(trim(x), '\"')), '|')"),
    "x40_memory_limit": ("type_text", "id", "s", lambda c: S.memory_limit(F.concat(F.length(c).cast("string"), F.lit("MB"))), "length(s) * 1048576"),
    "x41_property": ("fn", "id", "complexity", lambda c: F.coalesce(c.cast("string"), F.lit("")), "coalesce(cast(s as varchar), '')"),
    "x46_to_int": ("calls", "call_id", "receiver_expr", lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("int"), "try_cast(regexp_extract(s, '([0-9]+)$', 1) as int)"),
}
_TABLES = {"files", "calls"}
# Columns beside s that the SQL of some rows works with.
_EXTRA = {
    "x15_package": ", case when regexp_matches(s, '\\.(tsx?|jsx?|py)$') then regexp_extract(s, '^(.*)\\.[^.]*$', 1) else s end b",
    "x20_annotation_base": ", string_split(ltrim(s[1:1], '@') || s[2:], '(')[1] b",
    "x24_owner_outside_parens": ", coalesce(list_min(list_filter(range(1, length(s) + 1), lambda i: s[-i:-i] = '.' and length(replace(right(s, i), '(', '')) = length(replace(right(s, i), ')', '')))), 0) o",
}


def _query(source, key, text, function):
    def run(spark, sf_dir):
        df = read_table(spark, sf_dir, source) if source in _TABLES else view(spark, sf_dir, source)
        return df.select(F.col(key).alias("id"), F.col(text).alias("s")).distinct().select("id", function(F.col("s")).alias("value"))

    return run


def x16_symbol_id(spark, sf_dir):
    return view(spark, sf_dir, "fn").select("id", S.symbol_id(F.col("file_path"), F.col("qualified_name"), F.col("start_line")).alias("value"))


def x17_content_hash(spark, sf_dir):
    return read_table(spark, sf_dir, "files").select("rel_path", F.sha2("content", 256).alias("value")).distinct()


def queries() -> dict:
    out = {"x16_symbol_id": x16_symbol_id, "x17_content_hash": x17_content_hash}
    for name, (source, key, text, function, _) in ROWS.items():
        out[name] = _query(source, key, text, function)
        out[name].__name__ = name
    return out


def oracle_sql() -> dict:
    out = {"x16_symbol_id": with_views("select id, sha256(file_path || ':' || qualified_name || ':' || start_line)[1:16] value from fn"), "x17_content_hash": "select distinct rel_path, sha256(content) value from files"}
    for name, (source, key, text, _, sql) in ROWS.items():
        extra = _EXTRA.get(name, "")
        out[name] = with_views(f"select id, {sql} value from (select *{extra} from (select distinct {key} id, {text} s from {source}) q)")
    return out
