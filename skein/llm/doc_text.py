"""Documentation comments reduced to their text, or to nothing where they say nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SECTION = re.compile(r"(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Attributes|Throws|Examples?|Note|Notes|See Also)\s*:?\s*$", re.I)
_UNDERLINE = re.compile(r"[-=~^*#_. ]{2,}$")
_TAG = re.compile(r"@[A-Za-z]\w*|:(?:param|type|returns?|rtype|raises?|arg|keyword)\b")
_INLINE = re.compile(r"\{@(?:inheritDoc)\}|\{@(?:code|link|linkplain|literal|value)\s+([^}]*)\}", re.I)
_HTML = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&[a-z]+;")
_DIRECTIVE = re.compile(
    r"(?:#\s*)?(?:noqa|nolint|nosec|eslint\b|tslint\b|jshint\b|prettier-ignore|istanbul|type:\s*ignore|pylint:|pragma:?|mypy:|flake8|fmt:|isort:|go:\w+|\+build|lint:|@ts-|ts-(?:ignore|expect|nocheck)|noinspection|checkstyle|cspell|spell-?checker|export\s+\w+$|yapf:|codeql|sonar|nosonar|coverage:|c8 ignore|v8 ignore)", re.I
)
_LICENCE = re.compile(r"copyright\b|\(c\)\s*(?:19|20)\d\d|all rights reserved|@?licen[sc]ed?\b|SPDX-", re.I)
_GENERATED = re.compile(r"(?:this (?:file|code|method|class|function) (?:is|was|has been) )?(?:auto(?:matically)?[- ]?)?generated\b(?! (?:id|key|name|value)s?\b)|do not (?:edit|modify)\b|\(non-javadoc\)", re.I)
_PLACEHOLDER = re.compile(r"(?:todo|fixme|xxx|tbd|tba|wip|hack)\b|(?:n/?a|none|null|undocumented|no (?:documentation|description|docs)|see (?:code|below|above|source|name|title)|(?:documentation|docs|description)(?: is)? (?:pending|missing|to follow|goes here)|(?:add|write|missing) (?:documentation|docs|description|comment)|description|documentation|summary|self[- ]explanatory|lorem ipsum.*|placeholder)(?: here| this)?\s*[.!:]*$", re.I)
_CODE = re.compile(
    r".*[;{}]\s*$|[})\]];?$|(?:const|let|var|return|import|from|func|def|class|if|for|while|elif|else)\b.*[({:=;]\s*.*[;:{)]\s*$|[\w.\[\]]+\s*(?::=|=|\+=)\s*\S.*$|[\w.]+\([^)]*\)\s*;?$|>>> .*|\$ .*"
)
_FILLER = set("the a an of and to for in on this that it its is are with by from function method procedure routine constructor func fn def class object instance helper call calls called does do".split())


def _stem(word: str) -> str:
    """Word without inflection, written so that `applys`, `applies` and `apply` agree."""
    w = word.lower()
    for end in ("ing", "ied", "ies", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] in "yie" else w


def _name_words(text: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", text)


def _lines(doc: str, style: str) -> list[str]:
    if style == "string":
        m = re.match(r"[A-Za-z]*(\"\"\"|'''|\"|')", doc)
        body = doc[m.end() : -len(m.group(1))] if m else doc
        return body.splitlines()
    out = []
    for part in re.findall(r"/\*[\s\S]*?\*/|//[^\r\n]*", doc):
        if part.startswith("//"):
            out.append(part[2:])
        else:
            out += [re.sub(r"^\s*\*+ ?", "", line) for line in part[2:-2].splitlines()]
    return out


def _paragraphs(doc: str, style: str) -> list[list[str]]:
    """Lines of prose by paragraph: without tag blocks, sections, fenced code, rules and markup."""
    found: list[list[str]] = [[]]
    skipping = fenced = False
    for raw in _lines(doc, style):
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not line:
            skipping = False
            found.append([])
            continue
        if style == "lines" and re.match(r"\w+:\S", raw):
            continue
        plain = _HTML.sub(" ", line).strip()
        if _TAG.match(plain) and not _LICENCE.match(plain) or _SECTION.match(line):
            skipping = True
            found.append([])
            continue
        if skipping or not plain or _UNDERLINE.match(plain):
            continue
        plain = _INLINE.sub(lambda m: m.group(1) or " ", plain).strip(" \t*#-=_")
        if plain:
            found[-1].append(plain)
    return found


def real_text(doc: str | None, qualified_name: str, style: str) -> str:
    """The text of a documentation comment, '' if it is none: markup, tags, directives, notices, placeholders, licence
    lines, code and words that only repeat the function's name count as nothing. Text without letters is none. What a
    constructor's name would be is not in the code, so for it up to three words besides fillers count as a name."""
    kept: list[str] = []
    for lines in _paragraphs(doc or "", style):
        whole = " ".join(lines)
        if _LICENCE.match(whole) or _GENERATED.match(whole):
            continue
        kept += [x for x in lines if not (_DIRECTIVE.match(x) or _LICENCE.match(x) or _GENERATED.match(x) or _PLACEHOLDER.match(x) or _CODE.match(x))]
    text = " ".join(" ".join(kept).split())
    path = qualified_name.split(".")
    own = {_stem(w) for w in _name_words(path[-1])}
    words = [w for w in _name_words(text) if w.lower() not in _FILLER and not w.isdigit()]
    constructor = path[-1] in ("__init__", "constructor") or len(path) > 1 and path[-1] == path[-2]
    if constructor and len(words) <= 3 or all(_stem(w) in own for w in words):
        return ""
    return text


@F.pandas_udf(StringType())
def real_documentation(doc: pd.Series, qualified_name: pd.Series, style: pd.Series) -> pd.Series:
    return pd.Series([real_text(d, n, s) for d, n, s in zip(doc, qualified_name, style)], dtype=object)
