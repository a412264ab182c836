"""Tokens of the brace languages, shared by the parsers (problem 5) and by documentation pairs (problem 2).

A token is (type, start, end, on a new line). Types: ID, NUM, STR, CHR, LIFE
(a lifetime), a keyword or sign as itself, ";" inserted where Go's rules say so,
and END. Comments are kept apart. ``strict`` lexing raises on text that is no
token; tolerant lexing makes it a token of type BAD and goes on.
"""

from __future__ import annotations

import re


class Fail(Exception):
    """Text that is not of the language."""


# Fixed word lists: the reserved words of the languages.
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "ts": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with",
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_NUM = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|(?:\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?|[.]\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?\w*"
_TAIL = r"(?P<ID>[^\W\d]\w*)|(?P<NUM>" + _NUM + ")"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?s:.*?)\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"


def _signs(text: str) -> str:
    return "|".join(re.escape(s) for s in sorted(text.split(), key=len, reverse=True))


_PATTERNS = {
    "go": rf"(?P<WS>\s+)|(?P<COM>{_LINE}|{_BLOCK})|{_TAIL}|(?P<STR>{_DQ}|`[^`]*`)|(?P<CHR>'(?:\\[^\n]{{1,10}}?|[^'\\\n])')|(?P<OP>{_signs('<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~')})",
    "java": rf'(?P<WS>\s+)|(?P<COM>{_LINE}|{_BLOCK})|(?P<ID>(?:[^\W\d]|\$)[\w$]*)|(?P<NUM>{_NUM})|(?P<STR>"""(?s:(?:[^\\]|\\.)*?)"""|{_DQ})|(?P<CHR>\'(?:\\[^\n]{{1,6}}?|[^\'\\\n])\')|(?P<OP>{_signs(">>>= <<= >>= ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << + - * / & | ^ % < > = ! ~ ? : ( ) [ ] { } ; , . @")})',
    "ts": rf"(?P<WS>\s+)|(?P<COM>{_LINE}|{_BLOCK}|\A#![^\n]*)|(?P<ID>#?(?:[^\W\d]|\$)[\w$]*)|(?P<NUM>{_NUM})|(?P<STR>{_DQ}|{_SQ})|(?P<TPL>`)|(?P<OP>{_signs('>>>= ... <<= >>= **= &&= ||= ??= === !== => ** ++ -- && || ?? ?. == != <= >= += -= *= /= %= &= |= ^= << + - * / % & | ^ ~ < > = ! ? : ( ) [ ] { } ; , . @')})",
    "rust": rf"""(?P<WS>\s+)|(?P<COM>{_LINE})|(?P<NEST>/\*)|(?P<STR>b?r(?P<h>#+)"(?s:.*?)"(?P=h)|b?r"[^"]*"|[bc]?"(?:[^"\\]|\\(?s:.))*")|(?P<CHR>b?'(?:\\[^\n']{{1,10}}|\\'|[^'\\\n])')|(?P<LIFE>'[A-Za-z_]\w*)|(?P<ID>(?:r\#)?[^\W\d]\w*)|(?P<NUM>{_NUM.replace("|[.]", "|(?!)[.]")})|(?P<OP>{_signs('<<= >>= ..= ... => -> :: .. && || == != <= >= += -= *= /= %= ^= &= |= << + - * / % ^ ! & | = < > @ . , ; : # $ ? ( ) [ ] { } ~')})""",
}
_MASTER = {k: re.compile(v) for k, v in _PATTERNS.items()}
_GO_ENDS = frozenset("ID NUM STR CHR return break continue fallthrough ++ -- ) ] }".split())
_VALUES = frozenset("ID NUM STR TPL ) ] } this super true false null".split())
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
CLOSES = {")": "(", "]": "[", "}": "{"}
#: Tokens END after a text, so that parsers may look ahead.
ENDS = 3


def _template(text: str, at: int) -> int:
    """End of the template literal that begins at ``at``; -1 if it has none."""
    p, n = at + 1, len(text)
    while p < n:
        ch = text[p]
        if ch == "\\":
            p += 2
        elif ch == "`":
            return p + 1
        elif ch == "$" and text[p + 1 : p + 2] == "{":
            depth, p = 1, p + 2
            while p < n and depth:
                ch = text[p]
                if ch == "`":
                    p = _template(text, p)
                    if p < 0:
                        return -1
                    continue
                if ch in "\"'":
                    m = re.compile(f"{ch}(?:[^{ch}\\\\\\n]|\\\\.)*{ch}").match(text, p)
                    if not m:
                        return -1
                    p = m.end()
                    continue
                depth += (ch == "{") - (ch == "}")
                p += 1
        else:
            p += 1
    return -1


def _nested(text: str, at: int) -> int:
    depth, p = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(text, p):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return -1


class Tokens:
    """Parallel lists of a text's tokens, and its comments as (start, end)."""

    __slots__ = ("type", "start", "end", "fresh", "comments", "text")

    def __init__(self, language: str, text: str, strict: bool = True, limit: int | None = None):
        keywords, match = KEYWORDS[language], _MASTER[language].match
        types: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        fresh: list[bool] = []
        comments: list[tuple[int, int]] = []
        go, ts = language == "go", language == "ts"
        p, n, new = (1 if text[:1] == "﻿" else 0), len(text), True
        while p < n and (limit is None or len(types) < limit):
            m = match(text, p)
            kind = m.lastgroup if m else "BAD"
            if kind == "h":
                kind = "STR"
            q = m.end() if m else p + 1
            if kind == "WS" or kind == "COM":
                if "\n" in text[p:q]:
                    new = True
                if kind == "COM":
                    comments.append((p, q))
                    if text.startswith("//", p):
                        new = new or q >= n
                p = q
                if go and new and types and types[-1] in _GO_ENDS:
                    types.append(";")
                    starts.append(p)
                    ends.append(p)
                    fresh.append(False)
                continue
            if kind == "NEST" or kind == "TPL":
                q = _nested(text, p) if kind == "NEST" else _template(text, p)
                if q < 0:
                    if strict:
                        raise Fail(f"not closed at {p}")
                    q = n
                if kind == "NEST":
                    comments.append((p, q))
                    new = new or "\n" in text[p:q]
                    p = q
                    continue
                kind = "STR"
            elif kind == "OP":
                kind = m[0]
                if ts and kind in ("/", "/=") and not (types and types[-1] in _VALUES):
                    r = _REGEX.match(text, p)
                    if r:
                        kind, q = "STR", r.end()
                elif kind == "/" and text.startswith("/*", p):
                    if strict:
                        raise Fail(f"comment not closed at {p}")
                    comments.append((p, n))
                    break
            elif kind == "ID":
                word = m[0]
                if word in keywords:
                    kind = word
            elif kind == "BAD" and strict:
                raise Fail(f"no token at {p}")
            types.append(kind)
            starts.append(p)
            ends.append(q)
            fresh.append(new)
            new = False
            p = q
        if go and types and types[-1] in _GO_ENDS:
            types.append(";")
            starts.append(n)
            ends.append(n)
            fresh.append(False)
        types += ["END"] * ENDS
        starts += [n] * ENDS
        ends += [n] * ENDS
        fresh += [True] * ENDS
        self.type, self.start, self.end, self.fresh, self.comments, self.text = types, starts, ends, fresh, comments, text

    def matched(self, whole: bool = True) -> list[int]:
        """For each opening bracket the place of its closing one; raises where they do not match.

        Of a text's beginning (not ``whole``), brackets may close after the end.
        """
        to, stack = [0] * len(self.type), []
        for k, t in enumerate(self.type):
            if t == "(" or t == "[" or t == "{":
                stack.append(k)
            elif t in CLOSES:
                if not stack or self.type[stack[-1]] != CLOSES[t]:
                    raise Fail(f"bracket at {self.start[k]}")
                to[stack.pop()] = k
        if not whole:
            for k in stack:
                to[k] = len(self.type) - ENDS
        elif stack:
            raise Fail(f"bracket at {self.start[stack[-1]]}")
        return to
