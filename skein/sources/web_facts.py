"""Routes, remote calls, stored queries and annotations in source text, one row each, from one pass over a file's tokens.

Works for Java, Go, Python, TypeScript and JavaScript alike: what differs is in the fixed values. Texts that do not lex are
read as far as they do; null and empty contents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import language_of
from skein.sources.definitions import lombok_accessors
from skein.syntax.lexers import lex

WEB_FACTS = "file_path string, language string, fact string, line int, name string, target string, method string, framework string, detail string"

# Names that make routes, remote calls and stored queries.
SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}
GRAPHQL_SPRING = {"QueryMapping": "Query", "MutationMapping": "Mutation", "SubscriptionMapping": "Subscription"}
GRAPHQL_NEST = {"Query": "Query", "Mutation": "Mutation", "Subscription": "Subscription"}
NEST = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH"}
EXPRESS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "all": "GET"}
GO_ROUTES = {"GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH", "Handle": "GET", "Any": "GET"}
PYTHON_ROUTES = {"route": "GET", "get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH"}
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head")
HTTP_CLIENTS = {"python": ("requests", "httpx"), "typescript": ("axios", "got", "ky", "superagent"), "javascript": ("axios", "got", "ky", "superagent")}
GO_HTTP = {"Get": "GET", "Post": "POST", "Head": "HEAD"}
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH", "exchange": "UNKNOWN"}
ORM = {
    "python": {"query": "SELECT", "filter": "SELECT", "get": "SELECT", "all": "SELECT", "first": "SELECT", "add": "INSERT", "save": "INSERT", "commit": "INSERT", "create": "INSERT", "delete": "DELETE", "update": "UPDATE", "execute": "UNKNOWN"},
    "go": {"Find": "SELECT", "First": "SELECT", "Last": "SELECT", "Take": "SELECT", "Where": "SELECT", "Create": "INSERT", "Save": "INSERT", "Update": "UPDATE", "Updates": "UPDATE", "Delete": "DELETE", "Raw": "UNKNOWN", "Exec": "UNKNOWN"},
    "typescript": {
        "find": "SELECT", "findOne": "SELECT", "findMany": "SELECT", "findFirst": "SELECT", "findUnique": "SELECT", "findAll": "SELECT", "create": "INSERT", "save": "INSERT", "insert": "INSERT", "update": "UPDATE", "updateMany": "UPDATE",
        "delete": "DELETE", "deleteMany": "DELETE", "remove": "DELETE", "destroy": "DELETE", "query": "UNKNOWN", "createQueryBuilder": "SELECT",
    },
}
ORM_RECEIVERS = {"python": r"(?:^|\.)(?:session|db|objects|cursor)$", "go": r"(?:^|\.)(?:db|DB|tx|gorm)$", "typescript": r"(?i)(?:repository|repo|prisma\.\w+|model)$"}
# Tokens that count towards the complexity of a function.
_BRANCHES = {"if", "for", "while", "case", "catch", "?", "&&", "||"}
DECISIONS = {"java": _BRANCHES, "typescript": _BRANCHES | {"??"}, "javascript": _BRANCHES | {"??"}, "go": {"if", "for", "case", "&&", "||"}, "python": {"if", "elif", "for", "while", "except", "with", "and", "or"}}
_STATEMENT = re.compile(r"\s*(select|insert|update|delete)\s", re.I)
_TABLE = re.compile(r"(?:\s(?:from|into|join)\s+|^\s*update\s+)([^\s,();]+)", re.I)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _plain(literal: str) -> str:
    """Content of a string literal."""
    m = re.match(r"""[A-Za-z]{0,2}("{3}|'{3}|["'`])([\s\S]*)\1$""", literal)
    return m.group(2) if m else literal.strip("\"'`")


class _Source:
    def __init__(self, language: str, text: str):
        self.language, self.text = language, text
        self.tokens = [t for t in lex(language, text).tokens if t.kind != "NL"]
        self.close: dict[int, int] = {}
        self.open_at: dict[int, int] = {}
        self.around: list[int] = []  # innermost open bracket around each token, -1: none
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind in _CLOSE and stack:
                o = stack.pop()
                self.close[o], self.open_at[i] = i, o
            self.around.append(stack[-1] if stack else -1)
            if t.kind in _OPEN:
                stack.append(i)
        self.rows: list[tuple] = []

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> str:
        return self.text[self.tokens[i].start : self.tokens[i].end] if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        w = self.word(i)
        return bool(w) and (w[0].isalpha() or w[0] in "_$") and self.kind(i) not in ("STR", "TPL", "NUM", "CHAR", "REGEX")

    def receiver(self, i: int) -> str:
        """Dotted names before the name at i; calls within are shown as ()."""
        parts: list[str] = []
        while self.kind(i - 1) in (".", "?."):
            i -= 2
            suffix = ""
            while self.kind(i) in (")", "]") and i in self.open_at:
                suffix = "()" if self.kind(i) == ")" else suffix
                i = self.open_at[i] - 1
            if not self.is_name(i):
                break
            parts.append(self.word(i) + suffix)
        return ".".join(reversed(parts))

    def arguments(self, o: int) -> list[tuple[int, int]]:
        """Token ranges of the arguments behind the bracket at o."""
        end, out, a, i = self.close.get(o, len(self.tokens)), [], o + 1, o + 1
        while i < end:
            if self.kind(i) in _OPEN:
                i = self.close.get(i, end) + 1
                continue
            if self.kind(i) == ",":
                out.append((a, i))
                a = i + 1
            i += 1
        if a < end:
            out.append((a, min(end, len(self.tokens))))
        return out

    def literal(self, span: tuple[int, int]) -> str | None:
        """Text of an argument that is a string, or strings joined by +, others in it standing as ?."""
        parts, some = [], False
        for i in range(*span):
            if self.kind(i) in ("STR", "TPL"):
                parts.append(_plain(self.word(i)))
                some = True
            elif self.kind(i) not in ("+", "(", ")") and self.is_name(i) and self.kind(i + 1) != ".":
                parts.append("?")
        return "".join(parts) if some and not (self.kind(span[0]) in ("{", "[") or "=" in [self.kind(i) for i in range(*span)]) else None

    def shown(self, span: tuple[int, int]) -> str:
        return " ".join(self.text[self.tokens[span[0]].start : self.tokens[span[1] - 1].end].split()) if span[0] < span[1] else ""

    def put(self, fact: str, i: int, name: str = "", target: str = "", method: str = "", framework: str = "", detail: str = "") -> None:
        self.rows.append((fact, self.tokens[i].line, name, target, method, framework, detail))

    # ---- Annotations and decorators

    def annotation(self, i: int) -> tuple[str, dict[str, str], int]:
        """Name, arguments (value for the unnamed first) and the index behind an annotation whose @ is at i."""
        j = i + 1
        name = self.word(j)
        while self.kind(j + 1) == "." and self.is_name(j + 2):
            j += 2
            name += "." + self.word(j)
        params: dict[str, str] = {}
        if self.kind(j + 1) == "(":
            for n, (a, z) in enumerate(self.arguments(j + 1)):
                if self.is_name(a) and self.kind(a + 1) == "=" and z > a + 2:
                    params[self.word(a)] = self.shown((a + 2, z))
                elif n == 0 and a < z:
                    params["value"] = self.shown((a, z))
            j = self.close.get(j + 1, j + 1)
        return name, params, j + 1

    @staticmethod
    def values(text: str) -> list[str]:
        found = re.findall(r'"([^"]*)"|\'([^\']*)\'', text)
        return [a or b for a, b in found] or [text.strip("{} ")]

    def annotated(self) -> None:
        """Annotations with their owners, and the routes they make."""
        java, python = self.language == "java", self.language == "python"
        i, n, depth = 0, len(self.tokens), 0
        fields: list[tuple[str, str, str, int]] = []
        pending: list[tuple[int, str, dict[str, str]]] = []
        classes: list[tuple[int, str, list[str], str, str]] = []  # depth, name, prefixes, kind (feign, controller, ''), service
        while i < n:
            k = self.kind(i)
            if k == "@" and self.is_name(i + 1) and self.kind(i + 1) != "interface":
                name, params, j = self.annotation(i)
                pending.append((i, name, params))
                i = j
                continue
            if k == "{":
                depth += 1
            elif k == "}":
                depth -= 1
                while classes and classes[-1][0] > depth:
                    classes.pop()
                pending = []
            elif k in ("class", "interface", "enum") and self.kind(i - 1) not in (".", "?.") and self.is_name(i + 1):
                name = self.word(i + 1)
                for at, a, params in pending:
                    self.put("annotation", at, a, name, "class", "", _params(params))
                prefixes = [p for _, a, params in pending if a in ("RequestMapping", "Controller") for p in self.values(params.get("value", params.get("path", "")))] or [""]
                feign = next((params for _, a, params in pending if a == "FeignClient"), None)
                if feign is not None:
                    prefixes = self.values(feign.get("path", ""))
                classes.append((0 if python else depth + 1, name, prefixes, "feign" if feign is not None else "", self.values(feign.get("name", feign.get("value", "")))[0] if feign else ""))
                pending = []
            elif pending and (k == "def" and self.is_name(i + 1) or not python and self.is_name(i) and self.kind(i + 1) == "(" and self.kind(i - 1) not in (".", "new", "@", "?.")):
                at_name = i + 1 if k == "def" else i
                self.method_routes(pending, self.word(at_name), classes[-1] if classes else None, java, python)
                pending = []
                if not python:
                    i = self.close.get(i + 1, i + 1)
            elif k in (";", "=") and not python:
                for at, a, params in pending:
                    self.put("annotation", at, a, self.word(i - 1), "field", "", _params(params))
                    if a in ("DubboReference", "GrpcClient"):
                        self.put("remote", at, self.word(i - 1), self.values(params.get("value", ""))[0] or self.word(i - 2), "", "dubbo" if a == "DubboReference" else "grpc", "pending")
                pending = []
                if java and classes and classes[-1][0] == depth and self.is_name(i - 1) and (self.is_name(i - 2) or self.kind(i - 2) in (">", "]")):
                    fields.append((classes[-1][1], self.word(i - 1), self.word(i - 2) if self.is_name(i - 2) else "", i - 1))
            i += 1
        accessors: dict[str, set[str]] = {}
        for fact, _, a, target, kind, *_ in self.rows:
            if fact == "annotation" and kind == "class" and a in ("Data", "Getter", "Setter", "Value"):
                accessors.setdefault(target, set()).add(a)
        for owner, name, type_, at in fields:
            for accessor, returns, n in lombok_accessors(sorted(accessors.get(owner, ())), [(name, type_)]):
                self.put("accessor", at, accessor, owner, returns, "", str(n))

    def method_routes(self, pending: list, name: str, owner: tuple | None, java: bool, python: bool) -> None:
        handler = f"{owner[1]}.{name}" if owner and not python else name
        prefixes = owner[2] if owner else [""]
        for at, a, params in pending:
            self.put("annotation", at, a, handler, "method", "", _params(params))
            value = params.get("value", params.get("path", ""))
            if java and a in SPRING:
                verbs = re.findall(r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)", params.get("method", "")) if a == "RequestMapping" else []
                for prefix in prefixes:
                    for verb in verbs or [SPRING[a]]:
                        for path in self.values(value):
                            if owner and owner[3] == "feign":
                                self.put("route", at, handler, prefix + path, verb, "feign", owner[4])
                                self.put("remote", at, handler, prefix + path, verb, "feign", owner[4])
                            else:
                                self.put("route", at, handler, prefix + path, verb, "spring")
            elif java and a in GRAPHQL_SPRING:
                self.put("route", at, handler, self.values(params.get("name", value))[0] or name, GRAPHQL_SPRING[a], "graphql")
            elif java and a == "Query" and value:
                self.query(at, handler, " ".join(self.values(value)), "")
            elif python:
                self.python_route(at, a, params, value, name)
            elif not java and a in NEST:
                for prefix in prefixes:
                    path = self.values(value)[0]
                    whole = "/".join(x.strip("/") for x in (prefix, path) if x.strip("/"))
                    self.put("route", at, handler, "/" + whole, NEST[a], "nestjs")
            elif not java and a in GRAPHQL_NEST:
                self.put("route", at, handler, name, GRAPHQL_NEST[a], "graphql")

    def python_route(self, at: int, a: str, params: dict, value: str, name: str) -> None:
        last, first = a.rsplit(".", 1)[-1], a.split(".")[0]
        text = self.values(value)[0] if value else ""
        if "." not in a:
            return
        if last == "tool":
            self.put("route", at, name, text or name, "TOOL", "mcp")
        elif last in ("command", "group"):
            self.put("route", at, name, text or name, "CLI", "typer" if first == "app" else "click")
        elif last in PYTHON_ROUTES and text.startswith("/"):
            self.put("route", at, name, text, PYTHON_ROUTES[last], "flask" if first == "app" else "fastapi" if first == "router" else "python")
        elif first == "strawberry" and last in ("field", "mutation", "subscription"):
            self.put("route", at, name, name, {"field": "Query", "mutation": "Mutation", "subscription": "Subscription"}[last], "graphql")

    # ---- Calls

    def calls(self) -> None:
        language = "typescript" if self.language == "javascript" else self.language
        groups: dict[str, str] = {}
        stubs: dict[str, str] = {}
        for i in range(len(self.tokens)):
            if not (self.is_name(i) and self.kind(i + 1) == "("):
                continue
            name, r, args = self.word(i), self.receiver(i), self.arguments(i + 1)
            first = self.literal(args[0]) if args else None
            j = i - 1
            while self.kind(j) in (".", "?.") or self.is_name(j) and self.kind(j + 1) in (".", "?."):
                j -= 1
            j -= self.kind(j) == "new"
            assigned = self.word(j - 1) if self.kind(j) in ("=", ":=") and self.is_name(j - 1) else ""
            if name == "Group" and assigned and first is not None and language == "go":
                groups[assigned] = groups.get(r, "") + first
            self.route_call(language, i, name, r, args, first, groups)
            self.remote_call(language, i, name, r, args, first, stubs, assigned)
            table = ORM.get(language, {})
            if r and name in table and re.search(ORM_RECEIVERS[language], r):
                sql = first if first and (table[name] == "UNKNOWN" or _STATEMENT.match(first)) else None
                self.query(i, r, sql if sql else f"{r}.{name}(...)", table[name])

    def route_call(self, language: str, i: int, name: str, r: str, args: list, first: str | None, groups: dict) -> None:
        handler = self.shown(args[-1]) if len(args) > 1 else ""
        handler = handler if re.fullmatch(r"[\w.$]+", handler) else "lambda" if handler else ""
        if language == "go" and name in GO_ROUTES and r and first is not None and len(args) > 1:
            self.put("route", i, handler, groups.get(r, "") + first, GO_ROUTES[name], "gin")
        elif language == "go" and name in ("NewTool", "AddTool") and first:
            self.put("route", i, handler, first, "TOOL", "mcp")
        elif language == "typescript" and name in EXPRESS and r:
            chain = re.match(r"(.*\.)?route\(\)", r)
            if chain:
                j = i
                while self.kind(j - 1) in (".", "?.") and self.kind(j - 2) == ")":
                    o = self.open_at[j - 2]
                    j = o - 1
                    if self.word(j) == "route":
                        path = self.literal(self.arguments(o)[0]) if self.arguments(o) else None
                        if path is not None:
                            shown = self.shown(args[-1]) if args else ""
                            self.put("route", i, shown if re.fullmatch(r"[\w.$]+", shown) else "lambda", path, EXPRESS[name], "express")
            elif first is not None and first.startswith("/") and len(args) > 1 and r not in HTTP_CLIENTS["typescript"]:
                self.put("route", i, handler, first, EXPRESS[name], "express")
        elif language == "typescript" and name == "command" and r and first:
            self.put("route", i, handler, first.split()[0], "CLI", "commander")
        elif language == "typescript" and name in ("tool", "registerTool") and r and first:
            self.put("route", i, handler, first, "TOOL", "mcp")
        elif language == "python" and name in ("path", "re_path") and not r and first is not None and len(args) > 1:
            view = self.shown(args[1])
            self.put("route", i, view if re.fullmatch(r"[\w.]+", view) else "lambda", "/" + first.lstrip("/^"), "GET", "django")

    def remote_call(self, language: str, i: int, name: str, r: str, args: list, first: str | None, stubs: dict, assigned: str) -> None:
        if language in HTTP_CLIENTS and r in HTTP_CLIENTS[language] and name in HTTP_VERBS and first is not None:
            self.put("remote", i, "", first, name.upper(), "http")
        elif language == "typescript" and name == "fetch" and not r and first is not None:
            option = re.search(r"method\s*:\s*[\"'`](\w+)", self.shown(args[1])) if len(args) > 1 else None
            self.put("remote", i, "", first, option.group(1).upper() if option else "GET", "http")
        elif language == "go" and r == "http" and name in GO_HTTP and first is not None:
            self.put("remote", i, "", first, GO_HTTP[name], "http")
        elif language == "go" and name == "NewRequest" and len(args) > 1 and (url := self.literal(args[1])) is not None:
            verb = first if first is not None else self.shown(args[0]).rsplit("Method", 1)[-1].upper()
            self.put("remote", i, "", url, verb, "http")
        elif language == "java" and name in REST_TEMPLATE and re.search(r"(?i)resttemplate$", r) and first is not None:
            verb = re.search(r"HttpMethod\.(\w+)", " ".join(self.shown(a) for a in args[1:])) if name == "exchange" else None
            self.put("remote", i, "", first, verb.group(1) if verb else REST_TEMPLATE[name], "http")
        elif language == "go" and (m := re.fullmatch(r"New(\w+)Client|Register(\w+)Server", name)):
            if m.group(2):
                self.put("route", i, "", m.group(2), "", "grpc")
            elif assigned:
                stubs[assigned] = m.group(1)
        elif language == "python" and (m := re.fullmatch(r"(\w+)Stub|add_(\w+)Servicer_to_server", name)):
            if m.group(2):
                self.put("route", i, "", m.group(2), "", "grpc")
            elif assigned:
                stubs[assigned] = m.group(1)
        elif language == "java" and re.fullmatch(r"new(?:Blocking|Future)?Stub", name) and (m := re.search(r"(\w+)Grpc$", r)) and assigned:
            stubs[assigned] = m.group(1)
        elif language == "typescript" and self.kind(i - 1) == "new" and (m := re.fullmatch(r"(\w+)Client", name)) and assigned:
            stubs[assigned] = m.group(1)
        elif r.split(".")[-1] in stubs:
            self.put("remote", i, "", f"{stubs[r.split('.')[-1]]}/{name[:1].lower()}{name[1:]}", "", "grpc")

    # ---- Stored queries

    def query(self, i: int, name: str, sql: str, kind: str, detail: str = "") -> None:
        sql = " ".join(sql.split())
        found = _STATEMENT.match(sql + " ")
        tables = ",".join(dict.fromkeys(t.strip("`\"") for t in _TABLE.findall(" " + sql if not sql.lower().startswith("update") else sql))) if found else ""
        self.put("query", i, name, sql, found.group(1).upper() if found else kind or "UNKNOWN", tables, detail)

    def sql_strings(self) -> None:
        """SQL built in variables: a first text, texts added to it, and those added under a condition, which are listed with
        it. Other SQL literals stand alone. A variable ends with the block it was first set in."""
        blocks: list[int] = [-1]
        known: dict[str, dict] = {}
        i, n = 0, len(self.tokens)
        done: set[int] = set()

        def emit(v: dict) -> None:
            if _STATEMENT.match("".join(v["text"]) + " "):
                extra = "; ".join(f"{c}: {t}" for c, t in v["extra"])
                self.query(v["at"], v["name"], "".join(v["text"]) + "".join(t for _, t in v["extra"]), "", extra)

        while i < n:
            k = self.kind(i)
            if k == "{":
                blocks.append(i)
            elif k == "}" and len(blocks) > 1:
                gone = blocks.pop()
                for name in [x for x, v in known.items() if v["block"] == gone]:
                    emit(known.pop(name))
            if self.is_name(i) and self.kind(i + 1) in ("=", ":=", "+="):
                z = i + 2
                while z < n and self.kind(z) in ("STR", "TPL", "+", "(", ")", "ID") and (self.kind(z) != "ID" or self.kind(z - 1) == "+"):
                    z += 1
                text = self.literal((i + 2, z)) if z > i + 2 else None
                if text is not None:
                    name = self.word(i)
                    if self.kind(i + 1) == "+=" and name in known:
                        v = known[name]
                        condition = self.condition(i, v)
                        if condition:
                            v["extra"].append((condition, text))
                        else:
                            v["text"].append(text)
                        done.update(range(i + 2, z))
                    elif _STATEMENT.match(text + " "):
                        if name in known:
                            emit(known.pop(name))
                        known[name] = {"at": i, "name": name, "text": [text], "extra": [], "block": blocks[-1], "column": self.column(i)}
                        done.update(range(i + 2, z))
            elif k in ("STR", "TPL") and i not in done and _STATEMENT.match(_plain(self.word(i))) and self.kind(i - 1) not in ("+",):
                self.query(i, "", _plain(self.word(i)), "", "literal")
            i += 1
        for v in known.values():
            emit(v)

    def column(self, i: int) -> int:
        return self.tokens[i].start - (self.text.rfind("\n", 0, self.tokens[i].start) + 1)

    def condition(self, i: int, v: dict) -> str:
        """Condition of the innermost if between the variable's first text and the token at i."""
        if self.language == "python":
            if self.column(i) <= v["column"]:
                return ""
            j = i
            while j > v["at"] and not (self.kind(j) in ("if", "elif") and self.column(j) < self.column(i)):
                j -= 1
            if self.kind(j) not in ("if", "elif"):
                return ""
            z = j + 1
            while z < i and self.kind(z) != ":":
                z += 1
            return self.shown((j + 1, z))
        j, depth = i - 1, 0
        while j > v["at"]:
            depth += (self.kind(j) == "}") - (self.kind(j) == "{")
            if depth < 0:
                z = j
                while j > v["at"] and self.kind(j) not in ("if", ";", "}"):
                    j -= 1
                return self.shown((j + 1, z)).strip("()") if self.kind(j) == "if" else ""
            j -= 1
        return ""

    # ---- Expressions

    def expressions(self) -> None:
        """Constants of switch labels, lambdas, assignments of variables, chains of calls, and decisions."""
        decisions = DECISIONS[self.language]
        for i in range(len(self.tokens)):
            k = self.kind(i)
            if k in decisions and not (k == "?" and self.kind(i + 1) in (".", ":", ")", ",", ">", ";")):
                self.put("decision", i, k)
            if k == "case" and self.is_name(i + 1) and self.language != "python":
                j = i + 1
                while self.kind(j) not in (":", "->", "{", "}", ";", "case", ""):
                    if self.is_name(j) and self.kind(j + 1) in (":", "->", ",", ".") and self.kind(j - 1) != ".":
                        z = j
                        while self.kind(z + 1) == "." and self.is_name(z + 2):
                            z += 2
                        self.put("const_ref", j, self.word(z), self.shown((j, z + 1)))
                        j = z
                    j += 1
            elif k in ("->", "=>", "lambda") and (k != "->" or self.language == "java"):
                o = i - 1
                first = self.open_at.get(o, o) if k != "lambda" else i
                inside = self.around[first]
                inside = inside if inside > 0 and self.kind(inside) == "(" and self.is_name(inside - 1) else -1
                bound = self.word(first - 2) if self.kind(first - 1) == "=" else ""
                self.put("lambda", i, bound, self.word(inside - 1) if inside >= 0 else "", "", "", self.receiver(inside - 1) if inside >= 0 else "")
            elif k in ("=", ":=") and self.is_name(i - 1) and self.kind(i - 2) not in (".", "?."):
                self.assignment(i)
            elif self.is_name(i) and self.kind(i + 1) == "(" and self.kind(i - 1) not in ("new", "@", "function", "def", "func"):
                end = self.close.get(i + 1, i + 1)
                if self.kind(i - 1) in (".", "?.") and self.kind(i - 2) == ")" or self.kind(end + 1) in (".", "?.") and self.kind(end + 3) == "(":
                    depth, j = 1, i
                    while self.kind(j - 1) in (".", "?.") and self.kind(j - 2) == ")" and j - 2 in self.open_at:
                        depth += 1
                        j = self.open_at[j - 2] - 1
                    while self.kind(end + 1) in (".", "?.") and self.kind(end + 3) == "(":
                        end = self.close.get(end + 3, len(self.tokens))
                    self.put("chain", i, self.word(i), str(self.tokens[min(end, len(self.tokens) - 1)].line), "", "", str(depth))

    def assignment(self, i: int) -> None:
        """Kind of what a variable is set to: copy, field_access, call_result, method_call_result or constructor."""
        j = i + 1
        fresh = self.kind(j) in ("new", "await", "&")
        made = self.kind(j) == "new"
        j += fresh
        if not self.is_name(j):
            return
        path = [self.word(j)]
        while self.kind(j + 1) in (".", "?.") and self.is_name(j + 2):
            j += 2
            path.append(self.word(j))
        if self.kind(j + 1) == "(":
            kind = "constructor" if made else "method_call_result" if len(path) > 1 else "call_result"
        elif self.kind(j + 1) in (";", "", "}", ")", ",") or self.tokens[j + 1].line > self.tokens[j].line:
            kind = "field_access" if len(path) > 1 else "copy"
        else:
            return
        self.put("assignment", i, self.word(i - 1), ".".join(path), kind)

    def facts(self) -> list[tuple]:
        self.annotated()
        self.expressions()
        self.calls()
        self.sql_strings()
        return self.rows


def _params(params: dict[str, str]) -> str:
    return ", ".join(f"{k}={v}" for k, v in params.items())


def file_web_facts(language: str, text: str) -> list[tuple]:
    """(fact, line, name, target, method, framework, detail) of one text."""
    return _Source(language, text).facts()


def web_facts(files: DataFrame) -> DataFrame:
    """Facts of all files (rel_path, content) of a known language, one row each: route (name: handler, target: path), remote
    (target: URL or service/method, framework: protocol), query (target: SQL, method: type, framework: tables, detail:
    conditional parts), annotation (name, target: owner, method: kind of owner, detail: arguments), accessor (name, target:
    class, method: type, detail: parameters), const_ref, lambda (name: variable, target: call it is handed to), assignment
    (method: kind), chain (detail: depth, target: line of the outermost call) and decision. Files are
    independent; nothing is shuffled. A repeated file repeats its facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WEB_FACTS.split(", ")]
        for batch in batches:
            paths, languages, contents = (batch.column(k).to_pylist() for k in range(3))
            rows = [(p, lang, *r) for p, lang, c in zip(paths, languages, contents) if c for r in file_web_facts(lang, c.decode("utf-8-sig", "replace"))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            types = [pa.int32() if n == "line" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    known = files.where(F.col("rel_path").isNotNull()).select("rel_path", language_of(F.col("rel_path")).alias("language"), "content").where("language <> ''")
    return known.mapInArrow(run, WEB_FACTS)
