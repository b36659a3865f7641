"""Lexers: source text to tokens (class, start, end, line). Keywords and punctuation are classes of their own."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import partial
from typing import NamedTuple

# The reserved words of each language.
JAVA_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JS_WORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
PY_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
# Words with a meaning in some places only; elsewhere they are identifiers.
JAVA_SOFT = set("var record sealed permits non yield when module open".split())
JS_SOFT = set("async await of get set static let yield from as type interface implements private protected public readonly abstract declare namespace module is keyof infer asserts satisfies override accessor unique global new target any never unknown string number boolean symbol object bigint".split())
JS_SOFT.discard("new")
PY_SOFT = set("match case type _".split()) - {"_"}


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    line: int


class Lexed(NamedTuple):
    tokens: list[Token]
    comments: list[Token]
    bad: list[Token]


_NUMBER_TAIL = r"(?![\w$])"
_JAVA = re.compile(
    r"(?P<W>[ \t\f\r\n]+)|(?P<C>//[^\r\n]*|/\*[\s\S]*?\*/)"
    r'|(?P<S>"""[ \t\f]*\r?\n(?:\\[\s\S]|[^\\])*?"""|"(?!"")(?:\\.|[^"\\\r\n])*"|"")'
    r"|(?P<CHAR>'(?:\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^'\\\r\n])')"
    r"|(?P<N>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)[lLfFdD]?)" + _NUMBER_TAIL +
    r"|(?P<I>(?:[^\W\d]|\$)[\w$]*)|(?P<O>\.\.\.|->|::|<<=|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^=!<>?:;,.@~()\[\]{}])"
)
_GO = re.compile(
    r"(?P<W>[ \t\r]+)|(?P<L>\n)|(?P<C>//[^\n]*|/\*[\s\S]*?\*/)"
    r'|(?P<S>`[^`]*`|"(?:\\.|[^"\\\n])*")'
    r"|(?P<CHAR>'(?:\\[xuU]?[0-9a-fA-F]+|\\.|[^'\\\n])')"
    r"|(?P<N>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)i?)(?!\w)"
    r"|(?P<I>[^\W\d]\w*)|(?P<O>\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|<<|>>|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~:;,.()\[\]{}])"
)
_JS = re.compile(
    r"(?P<W>[ \t\f\v\u00a0\u2028\u2029\ufeff]+)|(?P<L>\r?\n|\r)|(?P<C>//[^\r\n]*|/\*[\s\S]*?\*/)"
    r"""|(?P<S>"(?:\\(?:\r\n|[\s\S])|[^"\\\r\n])*"|'(?:\\(?:\r\n|[\s\S])|[^'\\\r\n])*')"""
    r"|(?P<N>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)n?)" + _NUMBER_TAIL +
    r"|(?P<I>#?(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<O>\.\.\.|=>|===|!==|\*\*=|<<=|\*\*|<<|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||\+\+|--|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>?:;,.@~()\[\]{}])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[A-Za-z]*")
_PY = re.compile(
    r"(?P<W>[ \t\f]+|\\\r?\n)|(?P<L>\r?\n|\r)|(?P<C>#[^\r\n]*)"
    r"|(?P<S>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?!\"\")(?:\\(?:\r\n|[\s\S])|[^\"\\\r\n])*\"|'(?!'')(?:\\(?:\r\n|[\s\S])|[^'\\\r\n])*'|\"\"|''))"
    r"|(?P<N>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![\d_])|\d(?:_?\d)*(?=[.eEjJ]))(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?)[jJ]?)(?!\w)"
    r"|(?P<I>[^\W\d]\w*)|(?P<O>\.\.\.|\*\*=|//=|>>=|<<=|:=|->|\*\*|//|>>|<<|[-+*/%&|^=!<>@]=|[-+*/%&|^=<>~:;,.@()\[\]{}])"
)

_GO_END = {"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_JS_OPERAND = {"ID", "NUM", "STR", "TPL", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"} | JS_SOFT


def _template_end(s: str, at: int) -> int:
    """Index behind the template literal that begins at `at`, or -1."""
    i, n = at + 1, len(s)
    while i < n:
        c = s[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and s.startswith("{", i + 1):
            depth, i = 1, i + 2
            while i < n and depth:
                c = s[i]
                if c == "`":
                    i = _template_end(s, i)
                    if i < 0:
                        return -1
                    continue
                if c in "\"'":
                    m = re.compile(rf"{c}(?:\\[\s\S]|[^{c}\\\r\n])*{c}").match(s, i)
                    i = m.end() if m else i + 1
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return -1


def lex(language: str, s: str) -> Lexed:
    """Tokens, comments and unreadable places of a text. Classes: ID NUM STR CHAR TPL REGEX, words and punctuation;
    NL where a line end matters (Python, JavaScript, TypeScript) and ; where Go inserts one."""
    starts = [0] + [m.end() for m in re.finditer(r"\r\n|\n|\r", s)]
    tokens: list[Token] = []
    comments: list[Token] = []
    bad: list[Token] = []
    pattern, words, soft = {
        "java": (_JAVA, JAVA_WORDS, JAVA_SOFT), "go": (_GO, GO_WORDS, frozenset()), "python": (_PY, PY_WORDS, PY_SOFT),
        "javascript": (_JS, JS_WORDS, JS_SOFT), "typescript": (_JS, JS_WORDS, JS_SOFT),
    }[language]
    js, go, py = pattern is _JS, pattern is _GO, pattern is _PY
    match, i, n, depth = pattern.match, 0, len(s), 0
    if js and s.startswith("#!"):
        i = s.find("\n") if "\n" in s else n
    last = ""
    # Places only grow, so the line is counted along; a token is made without the detour over its class's constructor.
    line, following = 1, starts[1] if len(starts) > 1 else n + 1
    put, make = tokens.append, partial(tuple.__new__, Token)

    def line_at(a: int) -> int:
        return bisect_right(starts, a)

    while i < n:
        if js and s[i] in "/`":
            if s[i] == "`":
                e = _template_end(s, i)
                if e < 0:
                    bad.append(Token("BAD", i, n, line_at(i)))
                    break
                put(Token("TPL", i, e, line_at(i)))
                last = "TPL"
                i = e
                continue
            if last not in _JS_OPERAND and (m := _JS_REGEX.match(s, i)):
                put(Token("REGEX", i, m.end(), line_at(i)))
                last = "REGEX"
                i = m.end()
                continue
        m = match(s, i)
        if m is None:
            unfinished = s.startswith("/*", i) and not py
            e = n if unfinished or s.startswith(('"""', "'''"), i) and (py or language == "java") or go and s[i] == "`" else i + 1
            bad.append(Token("BAD", i, e, line_at(i)))
            last = "BAD"
            if e == i + 1 and s[i] in "\"'":  # an unfinished string: the rest of the line belongs to it
                while e < n and s[e] not in "\r\n":
                    e += 1
            i = e
            continue
        kind, e = m.lastgroup, m.end()
        if kind == "W":
            i = e
            continue
        while following <= i:
            line += 1
            following = starts[line] if line < len(starts) else n + 1
        if kind == "I":
            text = m.group()
            last = text if text in words or text in soft else "ID"
            put(make((last, i, e, line)))
        elif kind == "O":
            last = m.group()
            if py:
                depth += 1 if last in "([{" else -1 if last in ")]}" and depth else 0
            put(make((last, i, e, line)))
        elif kind == "C":
            comments.append(Token("CMT", i, e, line))
            if go and last in _GO_END and "\n" in s[i:e]:
                put(Token(";", i, i, line))
                last = ";"
        elif kind == "L":
            if go:
                if last in _GO_END:
                    put(Token(";", i, i, line))
                    last = ";"
            elif not (py and depth) and last != "NL":
                put(Token("NL", i, e, line))
                last = "NL"
        else:
            last = "STR" if kind == "S" else "NUM" if kind == "N" else kind
            put(make((last, i, e, line)))
        i = e
    if go and last in _GO_END:
        put(Token(";", n, n, line_at(n)))
    if "\0" in s and language in ("python", "go") and not bad:
        i = s.index("\0")
        bad.append(Token("BAD", i, i + 1, line_at(i)))
    return Lexed(tokens, comments, bad)
