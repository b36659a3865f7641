"""Build files and interface definitions as text: modules, frameworks, mappers, services, operations."""

from __future__ import annotations

import json
import re

# Build files in order of priority, and marks of frameworks in them.
BUILD_FILES = (("pom.xml", "maven"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"), ("go.mod", "go"), ("package.json", "npm"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("setup.py", "python"), ("Gemfile", "ruby"), ("composer.json", "php"), ("Cargo.toml", "rust"))
FRAMEWORKS = (
    ("spring-boot", "spring", "route"), ("spring-web", "spring", "route"), ("openfeign", "feign", "http_client"), ("dubbo", "dubbo", "rpc"), ("mybatis", "mybatis", "orm"), ("hibernate", "hibernate", "orm"),
    ("gin-gonic/gin", "gin", "route"), ("labstack/echo", "echo", "route"), ("gorm.io/gorm", "gorm", "orm"), ("google.golang.org/grpc", "grpc", "rpc"), ("fastapi", "fastapi", "route"), ("flask", "flask", "route"),
    ("django", "django", "route"), ("sqlalchemy", "sqlalchemy", "orm"), ("@nestjs/core", "nestjs", "route"), ("express", "express", "route"), ("typeorm", "typeorm", "orm"), ("graphql", "graphql", "graphql"),
)


def project_type(names: list[str]) -> tuple[str, list[str]]:
    """Type by the first known build file in order of priority, and all that are there."""
    hits = [(f, t) for f, t in BUILD_FILES if f in names]
    return (hits[0][1] if hits else "", [f for f, _ in hits])


def modules(name: str, text: str) -> list[str]:
    """Submodules named in a build file."""
    if name == "pom.xml":
        return [m.strip() for m in re.findall(r"<module>([^<]*)</module>", text)]
    if name.startswith("settings.gradle"):
        found = []
        for line in re.findall(r"include\s*\(?([^\n)]*)", text):
            found += [m.strip(":").replace(":", "/") for m in re.findall(r"[\"']([^\"']+)[\"']", line)]
        return found
    if name == "package.json":
        try:
            spaces = json.loads(text).get("workspaces", [])
        except (ValueError, AttributeError):
            return []
        return list(spaces.get("packages", []) if isinstance(spaces, dict) else spaces)
    if name == "go.work":
        block = re.search(r"use\s*\(([^)]*)\)", text)
        lines = block.group(1).split() if block else re.findall(r"^use\s+(\S+)", text, re.M)
        return [m.removeprefix("./") for m in lines]
    return []


def frameworks(texts: list[str]) -> list[tuple[str, str]]:
    """(name, category) of the frameworks that the build files mention, each once."""
    return list(dict.fromkeys((n, c) for t in texts for mark, n, c in FRAMEWORKS if mark in t))


def mapper_queries(xml: str) -> list[tuple[str, str, str]]:
    """(caller, kind, SQL) of each statement of a mapper file; the caller is namespace.id, white space is collapsed."""
    space = re.search(r"<mapper[^>]*\bnamespace\s*=\s*\"([^\"]*)\"", xml)
    if not space:
        return []
    out = []
    for m in re.finditer(r"<(select|insert|update|delete)\b[^>]*\bid\s*=\s*\"([^\"]*)\"[^>]*>([\s\S]*?)</\1>", xml):
        body = re.sub(r"<!\[CDATA\[|\]\]>|<[^>]*>", " ", m.group(3))
        out.append((f"{space.group(1)}.{m.group(2)}", m.group(1).upper(), " ".join(body.split())))
    return out


def proto_services(text: str) -> list[tuple[str, str]]:
    """(service, rpc) of a protocol definition, comments aside."""
    plain = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", " ", text)
    out = []
    for m in re.finditer(r"\bservice\s+(\w+)\s*\{", plain):
        depth, i = 1, m.end()
        while i < len(plain) and depth:
            depth += (plain[i] == "{") - (plain[i] == "}")
            i += 1
        out += [(m.group(1), r) for r in re.findall(r"\brpc\s+(\w+)\s*\(", plain[m.end() : i])]
    return out


def graphql_operations(text: str) -> list[tuple[str, str]]:
    """(Query | Mutation | Subscription, field) of a schema."""
    plain = re.sub(r"\"\"\"[\s\S]*?\"\"\"|#[^\n]*", " ", text)
    out = []
    for kind, body in re.findall(r"\b(?:extend\s+)?type\s+(Query|Mutation|Subscription)\b[^{]*\{([^}]*)\}", plain):
        out += [(kind, f) for f in re.findall(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:", body, re.M)]
    return out


def type_tree(text: str) -> tuple[str, list]:
    """A generic type as (name, arguments), nested."""
    text = text.strip()
    o = text.find("<")
    if o < 0 or not text.endswith(">"):
        return text, []
    parts, depth, start = [], 0, o + 1
    for i in range(o + 1, len(text) - 1):
        c = text[i]
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:-1])
    return text[:o].strip(), [type_tree(p) for p in parts]


def type_text(tree: tuple[str, list]) -> str:
    name, args = tree
    return name + (f"<{', '.join(type_text(a) for a in args)}>" if args else "")


def last_dot_outside_parens(text: str) -> int:
    depth = 0
    for i in range(len(text) - 1, -1, -1):
        depth += (text[i] in ")]}") - (text[i] in "([{")
        if text[i] == "." and depth == 0:
            return i
    return -1


def path_aliases(text: str) -> list[tuple[str, str]]:
    """(alias prefix, target folder) of a tsconfig: its paths below baseUrl, stars dropped; comments and trailing commas
    are allowed. A baseUrl without paths is the alias ''."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m.group(1) or "", text)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    base = str(options.get("baseUrl", "")).removeprefix("./").strip("/")
    join = lambda t: "/".join(x for x in (base if base != "." else "", str(t).removeprefix("./").rstrip("*").strip("/")) if x)
    found = [(alias.rstrip("*"), join(targets[0])) for alias, targets in options.get("paths", {}).items() if targets]
    return found or ([("", base)] if base else [])


# Where each kind of storage is found if nothing else is said.
STORAGE_DEFAULTS = {"falkordb": "localhost:6379", "kuzu": "graph.db", "ladybug": "graph.db", "parquet": "warehouse"}


def storage_address(backend: str, explicit: str = "", configured: str = "", environment: str = "") -> str:
    """Address of a store: one stated on the call, else the environment's, else the configuration's, else the default."""
    return explicit or environment or configured or STORAGE_DEFAULTS.get(backend, "")


def lombok_accessors(annotations: list[str], fields: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(name, return type, number of parameters) of the accessors that class annotations make for fields (name, type)."""
    getters, setters = {"Data", "Getter", "Value"} & set(annotations), {"Data", "Setter"} & set(annotations)
    out: list[tuple[str, str, int]] = []
    for name, type_ in fields:
        cap = name[:1].upper() + name[1:]
        if getters:
            out.append((("is" if type_ == "boolean" else "get") + cap, type_, 0))
        if setters:
            out.append(("set" + cap, "void", 1))
    return out
