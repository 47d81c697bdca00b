"""
Facts of JavaScript and TypeScript sources from tokens: no grammar is needed for imports, requires, declared
functions and classes, calls and leading doc comments. Text in strings, templates, comments and regular expressions is no code;
expressions within templates are, to any depth, as are JSX attributes where their tokens are.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<doc>/\*\*(?:[^*]|\*(?!/))*\*/)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<op>=>|\?\.|\.\.\.|[^\w\s])"""
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{|\\?$)")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "delete", "void", "in", "of", "do", "else", "case", "throw", "yield", "super", "with", "import"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) without spaces and plain comments."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1
    inside: list[int] = []  # for every template whose expression is being read: braces that are open in it
    while at < len(text):
        m = None
        if text[at] == "`" or text[at] == "}" and inside and not inside[-1]:
            # a template's text, from its beginning or after an expression, to its end or to the next expression
            if text[at] == "}":
                inside.pop()
            m = _TEMPLATE.match(text, at + 1)
            if m[0].endswith("${"):
                inside.append(0)
            out.append(("op", "`", line))
            line += m[0].count("\n")
            at = m.end()
            continue
        if inside and text[at] in "{}":
            inside[-1] += 1 if text[at] == "{" else -1
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            last = next((t for t in reversed(out) if t[0] != "doc"), ("op", "(", 0))
            if last[0] == "op" and last[1] not in ")]}" or last[1] in ("return", "typeof", "case", "in", "of"):
                m = _REGEX.match(text, at)
                if m:
                    out.append(("regex", m[0], line))
        if m is None:
            m = _TOKEN.match(text, at)
            if m is None:
                at += 1
                continue
            if m.lastgroup not in ("space", "comment"):
                out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


def parse(source: bytes) -> dict | None:
    t = tokens(source.decode("utf-8", "replace"))
    return {"imports": _imports(t), "definitions": _definitions(t), "calls": _calls(t)}


def _word(t, k: int) -> str:
    return t[k][1] if 0 <= k < len(t) and t[k][0] != "doc" else ""


def _imports(t) -> list[tuple[str, list[str], str | None, int]]:
    out = []
    for k, (kind, text, line) in enumerate(t):
        if kind != "name":
            continue
        if text == "import" and _word(t, k - 1) != "." and _word(t, k + 1) not in ("(", "."):
            symbols, alias, j, depth = [], None, k + 1, 0
            while j < len(t) and t[j][0] != "string" and not (t[j][1] == ";" and not depth):
                w = t[j][1]
                depth += (w == "{") - (w == "}")
                if w == "*":
                    symbols.append("*")
                    alias = _word(t, j + 2) if _word(t, j + 1) == "as" else None
                    j += 2
                elif t[j][0] == "name" and w not in ("from", "type"):
                    if _word(t, j - 1) == "as":
                        pass  # the original name counts
                    elif w != "as" or _word(t, j - 1) in ("{", ","):
                        symbols.append(w)
                j += 1
            if j < len(t) and t[j][0] == "string":
                out.append((t[j][1][1:-1], symbols, alias, line))
        elif text == "require" and _word(t, k - 1) != "." and _word(t, k + 1) == "(" and k + 2 < len(t) and t[k + 2][0] == "string":
            out.append((t[k + 2][1][1:-1], [], None, line))
    return out


def _definitions(t) -> list[tuple[str, str, int, str | None]]:
    out, seen = [], set()
    for k, (kind, text, _) in enumerate(t):
        if kind != "name" or text not in ("function", "class"):
            continue
        before = k - 1
        while _word(t, before) in ("async", "default", "export", "abstract", "declare"):
            before -= 1
        if before >= 0 and t[before][0] != "doc" and t[before][1] not in (";", "}", "{", ")") and t[before][2] == t[k][2]:
            continue  # an expression, not a declaration
        j = k + 1 + (_word(t, k + 1) == "*")
        if j < len(t) and t[j][0] == "name" and t[j][1] not in ("extends",):
            key = (t[j][1], t[j][2])
            if key not in seen:
                seen.add(key)
                doc = first_doc_line(t[before][1]) if before >= 0 and t[before][0] == "doc" else None
                out.append((t[j][1], "class" if text == "class" else "function", t[j][2], doc))
    return sorted(out, key=lambda d: d[2])


def _calls(t) -> list[tuple[str, int]]:
    out = []
    for k in range(1, len(t)):
        if t[k][1] != "(" or t[k - 1][0] != "name" or t[k - 1][1] in _KEYWORDS:
            continue
        first = k - 1
        while _word(t, first - 1) in (".", "?.") and first >= 2 and t[first - 2][0] == "name":
            first -= 2
        before = _word(t, first - 1)
        name = "".join(x[1] for x in t[first:k])
        if before in ("function", "class", "new", ".", "?.") or name == "require" or before == "*" and _word(t, first - 2) == "function":
            continue
        close = _closing(t, k)
        if first == k - 1 and _word(t, close + 1) == "{" and before in ("{", "}", ";", "async", "static", "get", "set", ""):
            continue  # a method's own declaration
        out.append((name, t[first][2]))
    return sorted(out, key=lambda c: c[1])


def _closing(t, k: int) -> int:
    depth = 0
    for j in range(k, len(t)):
        depth += (t[j][1] == "(") - (t[j][1] == ")")
        if not depth:
            return j
    return len(t)


def first_doc_line(comment: str) -> str | None:
    """The first line of a doc comment that is neither blank nor a tag."""
    for line in comment.removeprefix("/**").removesuffix("*/").split("\n"):
        line = line.strip().removeprefix("*").strip()
        if line and not line.startswith("@"):
            return line
    return None
