"""Problem 2: functions paired with their documentation.

Method: every file is read into tokens that tolerate damage; declarations of
functions and methods, the class they belong to and that class's parents come
out with the comment directly above them or, in Python, the docstring. A comment
counts if, without tool directives, placeholders, rulers, licence text,
commented-out code, bare tags and the words of the name, at least MIN_WORDS
words of prose remain. Methods whose comment is missing or only asks for the
inherited one are joined, level by level, with the method of that name in their
class's parents until a documented one is found or the hierarchy ends; those
left without are dropped. A class's parents are looked for in its file, its
imports, its folder and its repo, in this order.

Defined results: null or empty content and null or unknown languages give no
rows; a repeated file counts once (rows are distinct); equal declarations on
different lines are different rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.lexers import KEYWORDS, Tokens
from lodestrata.sources.tables import cut

MIN_WORDS = 5


class Function(NamedTuple):
    symbol: str
    start_line: int
    end_line: int
    owner: str | None
    parents: list[str]
    doc: str | None
    inherits: bool
    code: str


# --- what is prose -----------------------------------------------------------
_DIRECTIVE = re.compile(
    r"^@?(?:nolint|nosec|nosonar|noqa|noinspection|eslint-\w+|eslint|tslint|jshint|jslint|prettier-ignore|ts-(?:ignore|expect-error|nocheck|check)|biome-ignore|deno-lint|deno-fmt|clang-(?:format|tidy)|\+build|istanbul|checkstyle|rustfmt|nocover|swiftlint|ktlint|endregion|webpack\w*|suppresswarnings|suppress)(?=[\s:\-=(/\[]|$)"
    r"|^@?(?:pylint|flake8|mypy|pyright|ruff|isort|yapf|fmt|type|pragma|go|line|coverage|c8|v8|spotless|formatter|cspell|codespell|spellchecker|region|sourcery|bandit|lint|lgtm|jest|vitest|black|cgo)\s*:\s?\S|^#?(?:end)?region\b[^.]{0,40}$|^(?:NOSONAR|NOLINT|NOFOLLOW)\b|^pragma\s+\w+",
    re.I,
)
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|xxx|hack|wip|tbd|tba|n/?a|none|nil|pending|placeholder|undocumented|no (?:description|documentation|docs?|comment)|missing (?:description|documentation|docs?)|see (?:above|below)|(?:an? )?auto-?generated (?:method|constructor|function|catch)?\s*(?:stub|block|code|by)?|document (?:this|me)|add (?:a )?(?:description|documentation|docs?|comment)|description|write (?:me|docs?|this)|not documented|lorem ipsum)\b(?!\s+\w+\s+\w+\s+\w+\s+\w+)", re.I)
_TODO = re.compile(r"^\W*(?:todo|fixme|xxx|hack)\b", re.I)
_LICENCE = re.compile(r"\bcopyright\b|\(c\) \d{4}|spdx-license|all rights reserved|licensed under|\bthe terms of (?:the|this) .{0,30}licen[sc]e|use of this (?:source code|file) is governed|permission is hereby granted|terms kept in the repository|the text of those terms", re.I)
_TAG = re.compile(r"^(?:[@\\](?:param|arg|argument|tparam|typeparam|property|prop|throws|exception|raises|field|template)\b\s*(?:\{[^}]*\}\s*)?(?:\[?[\w.$\-]+(?:=[^\]]*)?\]?)?|[@\\](?:returns?|result|yields?|see|since|version|author|deprecated|type|override|inheritdoc|internal|public|private|protected|async|static|ignore|hidden|class|function|method|memberof|name|api|category|group|link)\b\s*(?:\{[^}]*\})?|[@\\]\w+|:(?:param|arg|type|raises?|rtype|returns?|var|ivar|keyword)\b[^:]*:)\s*[-:]?\s*(.*)$", re.I)
_SECTION = re.compile(r"^(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|yields|throws|errors?|panics|safety|examples?|notes?|attributes|see also)\s*:?\s*(?:-+)?$", re.I)
_FIELD = re.compile(r"^[`*]?[\w.$]+[`*]?\s*(?:\([^)]*\))?\s*[:\-–]\s+(.*)$")
_INHERIT = re.compile(r"\{?@inherit-?doc\}?|^\s*\(?inherited\)?\.?\s*$", re.I)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_CODE = re.compile(
    r"[(=\[\"'`].*;\s*(?://.*|#.*)?$|^\S+;$|[)\w] ?\{$|^\}|^(?:(?:const|let|var|final|mut|int|long|double|float|boolean|bool|String|List<.*>|Vec<.*>)\s+)+\w+.*=|^[\w.\[\]\"'`*&]+(?: [\w\[\]\"']+)*\s*(?:=|\+=|-=|\*=|/=|:=|==)\s*\S|^[\w.]+(?:, [\w.]+)+\s*:?=\s|^(?:\w+\.)*\w+!?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?\s*(?://.*|#.*)?$|^(?:if|for|while|switch|elif|else if|with|def|fn|func|function|class|import|from|return|defer|go|use|package|public|private|protected|try|except|catch)\b.*[(){}\[\]=:;<>]\s*$|^(?:return|defer|import|package|use)\s+[\w.:*\"']+(?:\([^)]*\))?\s*;?$|^(?:return|else|break|continue|pass)\s*;?$|^\w+\[[^\]]+\]\s*=|^@\w+$"
)


def lines_of(comment: str) -> list[str]:
    """Text lines of a comment without its marks."""
    out = []
    for line in comment.splitlines():
        line = line.strip()
        line = re.sub(r"^(?:/\*+!?|//+!?|#+!?(?!\w*\[)|--+(?=\s|$))", "", line)
        line = re.sub(r"\**/$", "", line).strip()
        out.append(re.sub(r"^\*+(?=\s|$)", "", line).strip())
    return out


def name_words(name: str) -> set[str]:
    return {name.lower(), *(x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name))}


def _count(text: str, skip: set[str]) -> int:
    if _CJK.search(text):
        return len(_CJK.findall(text)) // 2 + sum(w.lower() not in skip for w in _WORDS.findall(_CJK.sub(" ", text)))
    return sum(w.lower() not in skip for w in _WORDS.findall(text.replace("_", " ")))


def prose(lines: list[str], name: str) -> str | None:
    """The documentation that comment lines hold, or None if it is missing or says nothing."""
    if any(_LICENCE.search(x) for x in lines):
        lines = [x for x in lines if not _LICENCE.search(x)]
        if len([x for x in lines if x]) <= 2:
            return None
    kept, total, skip = [], 0, name_words(name)
    tagged = fenced = False
    for x in lines:
        if x.startswith("```"):
            fenced = not fenced
            continue
        if not x:
            kept.append("")
            continue
        if fenced or _DIRECTIVE.search(x) or _TODO.match(x) or _PLACEHOLDER.match(x) or _CODE.search(x):
            continue
        if _SECTION.match(x):
            tagged = True
            kept.append(x)
            continue
        m = _TAG.match(x) or (_FIELD.match(x) if tagged else None)
        said = m[m.lastindex or 0] if m else x
        n = _count(said if not m else (m[1] or ""), skip)
        if n or m:
            kept.append(x)
            total += n
    return "\n".join(kept).strip() if total >= MIN_WORDS else None


# --- declarations ------------------------------------------------------------
class Lines:
    def __init__(self, text: str):
        self.text = text
        self.at = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, position: int) -> int:
        """0-based line of a position."""
        return bisect_right(self.at, position) - 1

    def content(self, line: int) -> str:
        end = self.at[line + 1] if line + 1 < len(self.at) else len(self.text)
        return self.text[self.at[line] : end].strip("\r\n \t")


def _own_line_comments(lines: Lines, comments: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Comments that share their lines with nothing else, by the line they end on."""
    out = {}
    for a, b in comments:
        first, last = lines.of(a), lines.of(max(a, b - 1))
        begin = lines.at[first]
        end = lines.at[last + 1] if last + 1 < len(lines.at) else len(lines.text)
        if not lines.text[begin:a].strip(" \t﻿") and not lines.text[b:end].strip():
            out[last] = (a, b)
    return out


def _above(lines: Lines, own: dict[int, tuple[int, int]], line: int, between: set[int], mark: tuple[str, ...]) -> str | None:
    """Text of the comment that ends directly above a line, over the lines of annotations."""
    k = line - 1
    while k in between:
        k -= 1
    if k not in own:
        return None
    a, b = own[k]
    if lines.text.startswith(mark, a):
        while True:
            up = own.get(lines.of(a) - 1)
            if up is None or not lines.text.startswith(mark, up[0]):
                break
            a = up[0]
    return lines.text[a:b]


_MODIFIERS = {
    "java": frozenset("public protected private static abstract final native synchronized strictfp default".split()),
    "rust": frozenset("pub async unsafe const extern default crate".split()),
    "ts": frozenset("export default async public private protected static readonly abstract override get set declare accessor".split()),
    "go": frozenset(),
}
_JAVA_PRIMITIVE = frozenset("boolean byte char double float int long short void".split())


def _closing(types: list[str], i: int) -> int:
    """Place of the bracket that closes the one at i; the end where none does."""
    depth = 0
    for k in range(i, len(types)):
        t = types[k]
        if t in "([{" and t:
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
            if depth <= 0:
                return k
        elif t == "END":
            return k
    return len(types) - 1


def _back_angle(types: list[str], i: int) -> int:
    """Place before the angle brackets that end at i."""
    depth = 0
    while i >= 0:
        t = types[i]
        depth += {">": 1, ">>": 2, ">>>": 3}.get(t, 0) - {"<": 1, "<<": 2}.get(t, 0)
        if depth <= 0:
            return i - 1
        if t in (";", "{", "}", "("):
            return i
        i -= 1
    return i


def _brace_functions(language: str, text: str) -> list[Function]:
    k = Tokens(language, text, strict=False)
    types, lines = k.type, Lines(text)
    own = _own_line_comments(lines, k.comments)
    said = lambda i: text[k.start[i] : k.end[i]]
    modifiers = _MODIFIERS[language]
    between: set[int] = set()
    if language in ("java", "ts"):
        for i, t in enumerate(types):
            if t == "@" and types[i + 1] == "ID":
                j = i + 1
                while types[j + 1] == "." and types[j + 2] == "ID":
                    j += 2
                if types[j + 1] == "(":
                    j = _closing(types, j + 1)
                if types[j + 1] == "END" or k.fresh[j + 1]:
                    between.update(range(lines.of(k.start[i]), lines.of(k.start[j]) + 1))
    elif language == "rust":
        for i, t in enumerate(types):
            if t == "#" and types[i + 1] == "[":
                j = _closing(types, i + 1)
                if k.fresh[j + 1]:
                    between.update(range(lines.of(k.start[i]), lines.of(k.start[j]) + 1))
    classes: list[tuple[int, int, str, list[str]]] = []  # (from, to, name, parents)
    if language in ("java", "ts", "rust"):
        for i, t in enumerate(types):
            if t in ("class", "interface", "enum", "trait") and types[i + 1] == "ID" and (i == 0 or types[i - 1] != "."):
                j, parents = i + 2, []
                while types[j] not in ("{", ";", "END", "("):
                    if types[j] == "ID" and types[j - 1] in ("extends", "implements", ",", ":", "+") or types[j] == "ID" and said(j - 1) == "implements":
                        parents.append(said(j))
                    j += 1
                if types[j] == "{":
                    classes.append((j, _closing(types, j), said(i + 1), [p for p in parents if p != "implements"]))
            elif t == "impl":
                j, names, target = i + 1, [], None
                while types[j] not in ("{", ";", "END"):
                    if types[j] == "for":
                        target = len(names)
                    elif types[j] == "ID" and types[j - 1] in ("impl", "for", ">", "::", "&"):
                        names.append(said(j))
                    j += 1
                if types[j] == "{" and names:
                    classes.append((j, _closing(types, j), names[-1], names[:target] if target else []))
    class_names = {c[2] for c in classes}
    out = []
    for i, t in enumerate(types):
        if t != "ID":
            continue
        nxt, prev = types[i + 1], types[i - 1] if i else "END"
        first = i
        if language == "go":
            if nxt not in ("(", "["):
                continue
            j = i - 1
            if j >= 0 and types[j] == ")":
                depth = 0
                while j >= 0:
                    depth += (types[j] == ")") - (types[j] == "(")
                    if not depth:
                        break
                    j -= 1
                j -= 1
            if j < 0 or types[j] != "func" or (j and types[j - 1] not in (";", "}", "{", ")") and not k.fresh[j]):
                continue
            first = j
        elif language == "rust":
            if prev != "fn" or nxt not in ("(", "<"):
                continue
            first = i - 1
            while first and (types[first - 1] in modifiers or types[first - 1] == "STR" and types[first - 2] == "extern" or types[first - 1] == ")" and _pub(types, first - 1)):
                first = first - 1 if types[first - 1] != ")" else _pub(types, first - 1)
        elif language == "java":
            if nxt != "(":
                continue
            after = types[_closing(types, i + 1) + 1]
            if after not in ("{", "throws", ";", "default", "["):
                continue
            j = i - 1
            if prev in _JAVA_PRIMITIVE or prev == "ID" and said(j) not in ("function", "record", "yield", "fn", "func", "def"):
                pass
            elif prev in (">", ">>", ">>>"):
                pass
            elif prev == "]":
                while j > 0 and types[j] in ("]", "["):
                    j -= 1
            elif (prev in modifiers or prev in ("{", "}", ";")) and said(i) in class_names and after in ("{", "throws"):
                j = i
            else:
                continue
            if j < i:  # over the type
                while True:
                    if types[j] in (">", ">>", ">>>"):
                        j = _back_angle(types, j)
                    if j >= 0 and (types[j] == "ID" or types[j] in _JAVA_PRIMITIVE):
                        j -= 1
                    if j >= 0 and types[j] == ".":
                        j -= 1
                        continue
                    break
                if j >= 0 and types[j] in (">",):
                    j = _back_angle(types, j)
                j += 1
            if j and types[j - 1] not in modifiers and types[j - 1] not in ("{", "}", ";", ")") and not (types[j - 1] == "ID" and types[j - 2] == "@") and types[j - 1] != "BAD" and not k.fresh[j]:
                continue
            if types[j - 1] in (".", "=", "->", "(", ",", "new", "return", "+", "?", ":", "::"):
                continue
            first = j
            while first and types[first - 1] in modifiers:
                first -= 1
        else:  # ts
            if prev == "function" or prev == "*" and i > 1 and types[i - 2] == "function":
                if nxt not in ("(", "<"):
                    continue
                first = i - 1 if prev == "function" else i - 2
            elif nxt in ("(", "<"):
                if not (prev in ("{", "}", ";", ",", "*", "END") or prev == ")" or types[i - 1] == "ID" and said(i - 1) in modifiers or prev in ("default", "STR") or k.fresh[i]):
                    continue
                if prev in (".", "=", "(", "new", "return", "=>", "?", ":", "&&", "||", "+"):
                    continue
                j = i + 1
                if nxt == "<":
                    depth = 0
                    while types[j] not in ("END", ";", "{"):
                        depth += {"<": 1}.get(types[j], 0) - {">": 1, ">>": 2}.get(types[j], 0)
                        j += 1
                        if depth <= 0:
                            break
                if types[j] != "(":
                    continue
                j = _closing(types, j) + 1
                if types[j] == ":":
                    j += 1
                    while types[j] not in ("END", ";", "=", "=>", "}", ")") and not (types[j] == "{" and types[j - 1] not in (":", "|", "&", "<", ",")):
                        j = _closing(types, j) + 1 if types[j] in ("{", "(", "[") else j + 1
                marked = types[i - 1] == "ID" and said(i - 1) in ("abstract", "public", "private", "protected")
                if types[j] != "{" and not (marked and types[j] == ";"):
                    continue
                if k.fresh[j] and prev not in ("{", "}", ";") and not marked:
                    continue
            elif nxt in ("=", ":"):
                if types[i - 1] not in ("const", "var") and not (types[i - 1] == "ID" and said(i - 1) in ("let", "static", "readonly", "private", "public", "protected")):
                    continue
                j = i + 1
                if nxt == ":":
                    while types[j] not in ("=", ";", "END"):
                        j = _closing(types, j) + 1 if types[j] in ("{", "(", "[") else j + 1
                j += 1
                if types[j] == "ID" and said(j) == "async":
                    j += 1
                if types[j] == "(":
                    e = _closing(types, j) + 1
                    if types[e] == ":":
                        while types[e] not in ("=>", ";", "END", "=", "{"):
                            e += 1
                    if types[e] != "=>":
                        continue
                elif not (types[j] == "function" or types[j] == "ID" and types[j + 1] == "=>"):
                    continue
                first = i - 1 if types[i - 1] in ("const", "var") or said(i - 1) == "let" else i
            else:
                continue
            while first and (types[first - 1] in ("export", "default", "*") or types[first - 1] == "ID" and said(first - 1) in modifiers):
                first -= 1
        out.append(_finish(language, k, lines, own, between, i, first, classes))
    return out


def _pub(types: list[str], i: int) -> int:
    """Where ``pub(...)`` that ends at i begins; 0 if it isn't one."""
    j = i
    while j > 0 and types[j] != "(":
        j -= 1
    return j - 1 if j > 0 and types[j - 1] == "pub" and i - j < 8 else 0


def _finish(language: str, k: Tokens, lines: Lines, own: dict, between: set[int], i: int, first: int, classes: list) -> Function:
    types, text = k.type, k.text
    name = text[k.start[i] : k.end[i]]
    line = lines.of(k.start[first])
    # an annotation on the declaration's own first line
    while first and line in between and lines.of(k.start[first - 1]) == line:
        first -= 1
    comment = _above(lines, own, line, between, ("//",))
    found = lines_of(comment) if comment else []
    j = i + 1
    if types[j] == "[" or types[j] == "<":
        while types[j] not in ("(", "END", "{", ";"):
            j += 1
    while types[j] not in ("{", ";", "END"):
        j = _closing(types, j) + 1 if types[j] in ("(", "[") else j + 1
        j = min(j, len(types) - 1)
    end = _closing(types, j) if types[j] == "{" else j
    end = min(end, len(types) - 1)
    last = k.end[end] if types[end] != "END" else len(text)
    owner = min((c for c in classes if c[0] < i < c[1]), key=lambda c: c[1] - c[0], default=None)
    doc = prose(found, name) if found else None
    inherits = doc is None and (not any(found) or any(_INHERIT.search(x) for x in found))
    return Function(name, lines.of(k.start[i]) + 1, lines.of(max(0, last - 1)) + 1, owner[2] if owner else None, list(owner[3]) if owner else [], doc, inherits, text[k.start[first] : last])


_PY = re.compile(r"(?P<COM>#[^\n]*)|(?P<STR>(?:[rRbBuUfF]{0,2})(?:\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'))")
_DEF = re.compile(r"^([ \t]*)(async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[])", re.M)
_CLASS = re.compile(r"^([ \t]*)class[ \t]+([^\W\d]\w*)[ \t]*(?:\(([^()]*)\))?[^\n]*:", re.M)
_DECORATOR = re.compile(r"^[ \t]*@[^\W\d]", re.M)


def _indent(s: str) -> int:
    return len(s.expandtabs(8))


def _python_functions(text: str) -> list[Function]:
    lines, comments, strings = Lines(text), [], {}
    masked = []
    at = 0
    for m in _PY.finditer(text):
        masked.append(text[at : m.start()])
        masked.append(re.sub(r"[^\n]", "\x00", m[0]) if m.lastgroup == "STR" else " " * len(m[0]))
        if m.lastgroup == "COM":
            comments.append(m.span())
        else:
            strings[m.start()] = m[0]
        at = m.end()
    code = "".join(masked) + text[at:]
    own = _own_line_comments(lines, comments)
    match: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            match[stack.pop()] = m.end()
    between: set[int] = set()
    for m in _DECORATOR.finditer(code):
        a = lines.of(m.end() - 1)
        p = code.find("(", m.end())
        end = code.find("\n", m.end())
        if p != -1 and (end == -1 or p < end) and p in match:
            end = code.find("\n", match[p])
        between.update(range(a, lines.of(len(code) - 1 if end == -1 else end) + 1))
    classes = [(m.start(), _indent(m[1]), m[2], [x.split("=")[0].strip().split(".")[-1] for x in (m[3] or "").split(",") if x.strip() and "=" not in x and "\x00" not in x]) for m in _CLASS.finditer(code)]
    out = []
    for m in _DEF.finditer(code):
        p = m.end()
        while p < len(code) and code[p] in "([ \t" and code[p] != " ":
            if p not in match:
                break
            p = match[p]
            while p < len(code) and code[p] in " \t":
                p += 1
        colon = code.find(":", p)
        broken = colon == -1 or "\n" in code[p:colon].replace("\\\n", "")
        line = lines.of(m.start(2) if m[2] else m.end(1))
        depth = _indent(m[1])
        doc_text = None
        end = len(lines.at)
        if not broken:
            body = re.compile(r"(?:[ \t]|\\\n|\n|\r)*").match(code, colon + 1).end()
            s = strings.get(body)
            if s is not None and not re.match(r"[rRuU]*[bBfF]", s) and (lines.of(body) == lines.of(colon) or _indent(text[lines.at[lines.of(body)] : body]) > depth):
                doc_text = re.sub(r"^[rRuU]*(\"\"\"|'''|\"|')", "", s)
                quote = re.match(r"[rRuU]*(\"\"\"|'''|\"|')", s)[1]
                doc_text = doc_text[: -len(quote)]
            for n in range(lines.of(colon) + 1, len(lines.at)):
                begin = lines.at[n]
                row = code[begin : lines.at[n + 1] if n + 1 < len(lines.at) else len(code)]
                if row.strip() and "\x00" not in row[:1] and _indent(row[: len(row) - len(row.lstrip(" \t"))]) <= depth and not row.lstrip().startswith(")"):
                    end = n
                    break
        while end - 1 > line and not lines.content(end - 1):
            end -= 1
        name = m[3]
        comment = _above(lines, own, line, between, ("#",))
        candidates = [re.split(r"\r?\n", doc_text)] if doc_text is not None else []
        candidates = [[x.strip() for x in c] for c in candidates] + ([lines_of(comment)] if comment else [])
        doc = next((d for d in (prose(c, name) for c in candidates) if d), None)
        owner = None
        for c in classes:
            if c[0] < m.start() and c[1] < depth:
                owner = c
        inherits = doc is None and (not any(any(c) for c in candidates) or any(_INHERIT.search(x) for c in candidates for x in c))
        a = lines.at[line]
        out.append(Function(name, lines.of(m.start(3)) + 1, end, owner[2] if owner and depth else None, list(owner[3]) if owner and depth else [], doc, inherits, text[a : lines.at[end] if end < len(lines.at) else len(text)].rstrip()))
    return out


def functions(language: str | None, text: str | None) -> list[Function]:
    """All declarations of functions and methods of a text."""
    if not text:
        return []
    if language == "python":
        return _python_functions(text)
    if language in KEYWORDS:
        return _brace_functions(language, text)
    return []


#: What is imported: the path after the word, in quotes or plain.
_IMPORTED = {
    "python": re.compile(r"^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import[ \t]+([\w, \t*()]+)|import[ \t]+([\w., \t]+))", re.M),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);", re.M),
    "go": re.compile(r"^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?\"([\w./-]+)\"[ \t]*$", re.M),
    "ts": re.compile(r"""(?:\bfrom|\bimport|\brequire\()[ \t]*["']([^"'\n]+)["']"""),
}
_SEGMENT = re.compile(r"[^\W\d]\w*")


def imported(language: str | None, text: str) -> list[str]:
    """Names of modules, packages and things that a text imports: the segments of the paths."""
    pattern = _IMPORTED.get(language)
    return sorted({s for m in pattern.finditer(text) for g in m.groups() if g for s in _SEGMENT.findall(g)}) if pattern else []


SCHEMA = "file_id long, repo string, language_id string, rel_path string, imports array<string>, symbol string, start_line int, end_line int, owner string, parents array<string>, doc string, inherits boolean, code string"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()]


def declared(files: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each declaration of (file_id, repo, language_id, content and, where given, rel_path).

    Imports come with declarations whose class has parents only. Without ``texts``
    the code is null and the documentation an empty text where there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, repos, langs, paths = (batch.column(k).to_pylist() for k in range(4))
            rows: list[tuple] = []
            for j, text in enumerate(batch.column(4)):
                text = text.as_py()
                imports = None
                for f in functions(langs[j], text):
                    if f.parents and imports is None:
                        imports = imported(langs[j], text)
                    if not texts:
                        f = f._replace(code=None, doc=None if f.doc is None else "")
                    rows.append((ids[j], repos[j], langs[j], paths[j], imports if f.parents else None, *f))
                if len(rows) > 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    path = F.col("rel_path") if "rel_path" in files.columns else F.lit(None).cast("string").alias("rel_path")
    return files.select("file_id", "repo", "language_id", path, "content").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=names)


def _hierarchy(rows: DataFrame) -> DataFrame:
    """(file_id, class, parent, parent_file): where the classes that a class extends are declared.

    Of equally named classes in a repo and language the one of the same file is
    taken, else one of a file or folder whose name is imported, else one of the same
    folder, else any; of several the least file. Every place is one row for each
    name before the join, so nothing multiplies where a name is common.
    """
    key = ["repo", "language_id", "class", "place"]
    stem, folder = F.regexp_extract("rel_path", r"([^/.]+)[^/]*$", 1), F.regexp_extract("rel_path", r"^(.*)/", 1)
    here = [F.concat(F.lit("file "), F.col("file_id").cast("string")), F.concat(F.lit("name "), stem), F.concat(F.lit("name "), F.regexp_extract(folder, r"([^/]+)$", 1)), F.concat(F.lit("folder "), folder), F.lit("repo")]
    classes = rows.filter("owner IS NOT NULL").select("repo", "language_id", F.col("owner").alias("class"), "file_id", "rel_path").distinct()
    places = classes.select("repo", "language_id", "class", "file_id", F.explode(F.array_compact(F.array(*here))).alias("place")).groupBy(*key).agg(F.min("file_id").alias("parent_file"))
    names = F.transform(F.coalesce("imports", F.array().cast("array<string>")), lambda s: F.struct(F.lit(1).alias("rank"), F.concat(F.lit("name "), s).alias("place")))
    near = [F.struct(F.lit(k).alias("rank"), p.alias("place")) for k, p in ((0, here[0]), (2, F.coalesce(here[3], F.lit("repo"))), (3, here[4]))]
    wanted = (
        rows.filter("owner IS NOT NULL AND size(parents) > 0").select("repo", "language_id", "file_id", "rel_path", F.col("owner").alias("child"), "imports", F.explode("parents").alias("class")).distinct()
        .select("repo", "language_id", "file_id", "child", "class", F.explode(F.concat(F.array(*near), names)).alias("p")).select("repo", "language_id", "file_id", "child", "class", "p.rank", "p.place")
    )
    best = wanted.join(places, key).groupBy("file_id", "child", "class").agg(F.min(F.struct("rank", "parent_file")).alias("b"))
    return best.select("file_id", F.col("child").alias("class"), F.col("class").alias("parent"), F.col("b.parent_file").alias("parent_file")).filter("NOT (file_id = parent_file AND class = parent)")


def resolved(rows: DataFrame) -> DataFrame:
    """``(file_id, symbol, start_line, level, doc)`` of the documented functions among declarations.

    Level 0 is a function's own documentation; a method that has none, or only asks
    for the inherited one, takes that of the nearest ancestor class that documents a
    method of the name, at the level where it is found; of several the one with the
    least file and line. Every round climbs one level, and a class met again ends
    its climb, so rounds are bounded by the depth of the hierarchy.
    """
    me = ["file_id", "symbol", "start_line"]
    out = rows.filter("doc IS NOT NULL").select(*me, F.lit(0).alias("level"), "doc")
    parents = cut(_hierarchy(rows))
    waiting = rows.filter("doc IS NULL AND inherits AND size(parents) > 0 AND owner IS NOT NULL").select(*me, F.col("file_id").alias("at"), F.col("owner").alias("class"), F.array(F.concat_ws(" ", "file_id", "owner")).alias("seen"))
    documented = rows.filter("owner IS NOT NULL AND doc IS NOT NULL").groupBy(F.col("file_id").alias("at"), F.col("owner").alias("class"), "symbol").agg(F.min(F.struct("start_line", "doc")).alias("best"))
    documented = documented.select("at", "class", "symbol", F.struct("at", "best.start_line", "best.doc").alias("found"))
    up = parents.select(F.col("file_id").alias("at"), "class", "parent", "parent_file")
    level = 0
    while True:
        level += 1
        climbed = waiting.join(up, ["at", "class"]).select(*me, F.col("parent_file").alias("at"), F.col("parent").alias("class"), "seen", F.concat_ws(" ", "parent_file", "parent").alias("step"))
        climbed = climbed.filter(~F.array_contains("seen", F.col("step"))).select(*me, "at", "class", F.concat("seen", F.array("step")).alias("seen")).distinct()
        met = cut(climbed.join(documented, ["at", "class", "symbol"], "left"))
        if met.isEmpty():
            return out
        hits = met.filter("found IS NOT NULL").groupBy(*me).agg(F.min("found").alias("found"))
        out = out.unionByName(hits.select(*me, F.lit(level).alias("level"), F.col("found.doc").alias("doc")))
        waiting = met.filter("found IS NULL").join(hits.select(*me), me, "left_anti").drop("found")


def found(files: DataFrame) -> DataFrame:
    """``(file_id, symbol, start_line)`` of functions whose own documentation says something: level 0 of the resolved pairs."""
    rows = cut(declared(files, texts=False))
    return resolved(rows).filter("level = 0").select("file_id", "symbol", "start_line").distinct()


def pairs(files: DataFrame) -> DataFrame:
    """``(file_id, symbol, start_line, code, doc, inherited)``: functions with own or inherited documentation.

    Own documentation stays with its code; only methods that inherit are joined.
    """
    me = ["file_id", "symbol", "start_line"]
    rows = cut(declared(files).filter("doc IS NOT NULL OR owner IS NOT NULL").dropDuplicates(me))
    own = rows.filter("doc IS NOT NULL").select(*me, "code", "doc", F.lit(False).alias("inherited"))
    taken = resolved(rows.drop("code")).filter("level > 0").select(*me, F.col("doc").alias("inherited_doc"))
    heirs = rows.filter("doc IS NULL AND inherits AND size(parents) > 0").select(*me, "code")
    return own.unionByName(heirs.join(taken, me).select(*me, "code", F.col("inherited_doc").alias("doc"), F.lit(True).alias("inherited")))
