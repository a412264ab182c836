"""Problem 3: credentials embedded in source code.

Method: token formats, key armor, connection strings, assignments, calls and
command lines are the patterns of one deterministic automaton (automaton.py).
Matches are begun in overlapping chunks and run on to their ends, however long a
value is; the spans found are absolute and deduplicated, and each is judged by its grammar: whether its name asks for a
credential and its value could be one, or is a placeholder, a reference, a
label, a digest or an id. Placeholders are spliced in for the values, from the
last span to the first, so the rest of the line keeps its text.

Defined results: null texts hold none and stay null; empty ones stay empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.automaton import Automaton

CHUNK, OVERLAP = 1 << 16, 1 << 13
PLACEHOLDER = "[REDACTED]"

# Fixed word lists.
STRONG = frozenset("password passwd pwd pass pw passphrase passcode secret apikey token clave kennwort passwort passe contrasena contrasenia senha auth xauth credential credentials cred creds jwt bearer pat".split())
KEYED = frozenset("api access secret private signing encryption master auth ssh service account shared hmac crypto cipher license".split())
PUBLIC = frozenset("public pub cache primary foreign sort partition row hash lookup".split())
NO_VALUES = frozenset(
    "todo fixme none null nil undefined true false changeme change_me change-me replaceme replace-me dummy example sample test testing placeholder redacted masked secret password passwd token string str bytes int char bool boolean number any object unknown optional self this bearer basic authorization hidden removed empty xxx yyy your-key-here insert default".split()
)

_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*"
_QUOTED = r"""(?:"[^"\n]*"?|'[^'\n]*'?|`[^`\n]*`?)"""
_BARE = r"""[^\s"'`;,(){}\[\]<>]{4,}"""
#: name of the grammar -> pattern of the automaton
GRAMMARS = {
    "access_id": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "web_token": r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}",
    "prefixed": r"[a-z]{2,10}[0-9]?(?:_[a-z]{2,6})?[_.-][A-Za-z0-9]{20,}",
    "armor": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----(?:[A-Za-z0-9+/=\s\\]|\\[nr])*",
    "key_line": r"[A-Za-z0-9+/]{64}",
    "url": r"""[A-Za-z][A-Za-z0-9+.-]+://[^\s:@/"'<>]*:[^\s@/"']+@""",
    "header": r"(?:Bearer|bearer|BEARER|Basic|basic|Token|token|ApiKey|apikey) [A-Za-z0-9+/=_.~-]{12,}",
    "assigned": rf"""["']?{_NAME}["']?\]?(?:: ?[A-Za-z&'<>\[\]]+)? ?(?:=|:=|:|=>|->|,) ?{_QUOTED}(?: ?\+ ?{_QUOTED})*""",
    "concat": rf"""{_NAME}(?:: ?[A-Za-z&'<>\[\]]+)? ?(?:=|:=|:) ?[a-zA-Z.]*!?\({_QUOTED}(?:, ?{_QUOTED})+""",
    "bare": rf"""["']?{_NAME}["']? ?(?:=|:=|:|=>) ?{_BARE}""",
    "fallback": rf"""(?:env|environ|getenv|getOrDefault|env_or|var|get)[.(\[]{{1,2}}["']?[A-Za-z_][A-Za-z0-9_]*["']?[\])]{{0,3}} ?(?:,|\|\||or|\?\?|\.unwrap_or\(|\.orElse\() ?{_QUOTED}""",
    "default": r"\$\{[A-Za-z_][A-Za-z0-9_]*:-[^\s}]+\}",
    "call": rf"""(?:login|log_in|logIn|sign_in|signIn|signin|authenticate|auth|connect|setPassword|set_password|withSecret|with_secret|withPassword|with_password|setCredentials|set_credentials|withCredentials|with_credentials|basicAuth|basic_auth|setAuth)(?:)\( ?{_QUOTED} ?, ?{_QUOTED}""",
    "user": r"""-{1,2}u(?:ser)?[ =][A-Za-z0-9_.-]+:[^\s"']+""",
    "option": r"""(?:sshpass -p ?|-{1,2}(?:password|passwd|pass|pwd|token|secret|api-key|apikey)[ =])[^\s"']+""",
    "element": rf"""<{_NAME}>[^<>\n]+</""",
    "told": r"""(?:[Pp]w|[Pp]ass|[Pp]wd|[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Kk]ey|[Ll]ogin|[Cc]redentials?|[Kk]ennwort|[Cc]lave)(?: [A-Za-z0-9_./:>=-]{1,20}){0,4}[ :=>-]{1,4}[^\s"']{6,}""",
}
IDS = list(GRAMMARS)


@lru_cache(1)
def automaton() -> tuple[Automaton, re.Pattern]:
    a = Automaton(list(GRAMMARS.values()))
    return a, a.starts()


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values()) if n else 0.0


def parts(name: str) -> list[str]:
    """Lower-case words of an identifier."""
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def asks(name: str) -> bool:
    """Whether a name stands for the value of a credential."""
    p = parts(name)
    if not p:
        return False
    if p[-1] in STRONG or p[-1].endswith(("password", "passwd", "passphrase", "secret", "apikey", "privatekey", "secretkey", "signingkey", "encryptionkey", "authtoken", "accesstoken")):
        return True
    if p[-1] == "key":
        return len(p) > 1 and p[-2] in KEYED
    return "".join(p[-2:]) in STRONG or (p[-1].isdigit() and len(p) > 1 and p[-2] in STRONG)


_REFERENCE = re.compile(
    r"^[<\[{(%$].*|\$\{|\$\(|\{\{|^\$[A-Za-z_]|^%[A-Za-z_]+%$|^(?:vault|ssm|secretsmanager|keyring|file|env|arn|kms|op|sops|gsm|awssm|k8s)[:/]|^(?:\.{0,2}/|~/)[a-z0-9_.-]+(?:/[a-z0-9_.-]+)*/?$|^[a-z]+(?:/[a-z_.-]+)+$|^(?:os|process|System|std|env|config|settings|self|this|secrets|ENC)[._:\[(]|^ENC_|://[^@]*$|^data:|^ssh-(?:rsa|ed25519|dss)|BEGIN (?:[A-Z]+ )*PUBLIC|BEGIN CERTIFICATE"
)
_MASKED = re.compile(r"^(?:[x*•.#_-]+|[X*]+|(?:your|my|the|an?|some|insert|enter|example|dummy|fake|not|replace|change|sample|test|placeholder|redacted|todo)[-_ ].*|(?:.*(?:-here|_here|-me)$)|.*(?:redacted|placeholder|example|your[_-]).*)$", re.I)
_ODD_CASE = re.compile(r"[A-Z]{2,}[a-z]|[a-z][A-Z]{2,}|[a-z][A-Z][a-z][A-Z]|[A-Z][a-z][A-Z]|[a-z][A-Z]$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_DIGEST = re.compile(r"^(?:sha\d+|md5)[-:]", re.I)
_TOKEN = re.compile("|".join(f"(?:{GRAMMARS[k]})" for k in ("access_id", "web_token", "prefixed")))


def _random(w: str) -> bool:
    """Whether the letters of a mixed-case word follow no language."""
    lower = re.search(r"[a-z]", w)
    if len(w) < 8 or not lower or not re.search(r"[A-Z]", w[lower.end() :]):
        return False
    vowels = len(re.findall(r"[aeiouy]", w, re.I)) / len(w)
    return vowels < 0.25 or bool(re.search(r"[^aeiouy\d]{4}", w, re.I))


def plain(v: str) -> bool:
    """Whether a value is a word, number, path or name rather than a secret."""
    if re.fullmatch(r"-?\d+(?:\.\d+)*", v):
        return True
    if re.fullmatch(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*\d{0,2}", v):
        return not any(_random(w) or _ODD_CASE.search(w) and not re.fullmatch(r"(?:[a-z]{2,})?(?:[A-Z][a-z]{2,})*", w) for w in re.split(r"[_.-]", v)) or len(v) < 8
    return False


def could_be(v: str, least: int = 6) -> bool:
    """Whether a literal value could be a usable credential."""
    v = v.strip()
    if v.lower().startswith(("bearer ", "basic ", "token ")):
        v = v.split(None, 1)[1]
    if len(v) < least or re.search(r"\s", v) or v.lower() in NO_VALUES:
        return False
    if _REFERENCE.search(v) or _MASKED.match(v) or _DIGEST.match(v):
        return False
    return not plain(v) and len(set(v)) > 3


def token_like(v: str) -> bool:
    m = _TOKEN.fullmatch(v)
    if not m:
        return False
    if v.startswith(("AKIA", "ASIA", "eyJ")):
        return True
    body = re.split(r"[_.-]", v)[-1]
    return bool(re.search(r"\d", body) and re.search(r"[A-Z]", body) and re.search(r"[a-z]", body)) and entropy(body) > 3.4


_STRING = re.compile(r"\"([^\"\n]*)\"?|'([^'\n]*)'?|`([^`\n]*)`?")


def _strings(text: str, at: int) -> list[tuple[int, int, str]]:
    """Spans and contents of the string literals of a match."""
    out = []
    for m in _STRING.finditer(text):
        g = next(k for k in (1, 2, 3) if m[k] is not None)
        out.append((at + m.start(g), at + m.end(g), m[g]))
    return out


_ASSIGNED = re.compile(rf"""["']?({_NAME})["']?\]?(?:: ?[A-Za-z&'<>\[\]]+)? ?(?:=|:=|:|=>|->|,) ?(?=["'`])""")
_BARE_HEAD = re.compile(rf"""["']?({_NAME})["']? ?[=:]""")
_BARE_PARTS = re.compile(rf"""["']?({_NAME})["']? ?(:=|=>|=|:) ?({_BARE})$""")


def judge(kind: str, m: str, at: int) -> list[tuple[int, int]]:
    """Absolute spans of the credentials in one match of a grammar; none if it holds no usable one."""
    if kind in ("access_id", "web_token"):
        return [(at, at + len(m))]
    if kind == "prefixed":
        return [(at, at + len(m))] if token_like(m) else []
    if kind == "armor":
        body = m.rfind("-----") + 5
        return [(at + body, at + len(m))] if re.search(r"[A-Za-z0-9+/]{16}", m[body:].replace("\\n", " ")) else []
    if kind == "key_line":
        mixed = all(re.search(x, m) for x in ("[a-z]", "[A-Z]", "[0-9]"))
        return [(at, at + len(m))] if mixed and entropy(m) > 4.6 else []
    if kind == "url":
        secret = m.index(":", m.index("://") + 3) + 1
        v = m[secret:-1]
        good = not (_REFERENCE.search(v) or _MASKED.match(v) or v.lower() in NO_VALUES) and len(v) >= 4
        return [(at + secret, at + len(m) - 1)] if good else []
    if kind == "header":
        k = m.index(" ") + 1
        v = m[k:].rstrip(".")
        strong = (re.search(r"\d", v) or _random(v) or _ODD_CASE.search(v)) and could_be(v, 12)
        return [(at + k, at + k + len(v))] if strong else []
    if kind in ("assigned", "concat"):
        head = _ASSIGNED.match(m) if kind == "assigned" else re.match(rf"({_NAME})", m)
        if not head:
            return []
        texts = _strings(m[head.end() :], at + head.end())
        if kind == "concat":
            texts = _strings(m[m.index("(") :], at + m.index("("))
        joined = "".join(t for _, _, t in texts)
        if len(texts) > 1 and token_like(joined) or asks(head[1]) and could_be(joined) and (kind == "assigned" or len(texts) > 1 and "concat" in m):
            return [(a, b) for a, b, _ in texts]
        return []
    if kind == "bare":
        g = _BARE_PARTS.fullmatch(m)
        if not g or not asks(g[1]):
            return []
        v = g[3]
        if re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->)[\w$]+)*", v) and not re.search(r"\d", v) and not _ODD_CASE.search(v) and not _random(v):
            return []
        return [(at + g.start(3), at + g.end(3))] if could_be(v) else []
    if kind == "fallback":
        texts = _strings(m, at)
        if not texts or len(texts[-1][2]) + 2 > len(m):
            return []
        name = re.search(r"[.(\[]+[\"']?([A-Za-z_]\w*)", m)
        return [texts[-1][:2]] if name and asks(name[1]) and could_be(texts[-1][2]) else []
    if kind == "default":
        name, v = m[2:-1].split(":-", 1)
        return [(at + m.index(":-") + 2, at + len(m) - 1)] if asks(name) and could_be(v) else []
    if kind == "call":
        texts = _strings(m[m.index("(") :], at + m.index("("))
        return [texts[1][:2]] if len(texts) > 1 and could_be(texts[1][2]) else []
    if kind == "user":
        k = m.index(":") + 1
        return [(at + k, at + len(m))] if could_be(m[k:], 4) else []
    if kind == "option":
        k = re.match(r"sshpass -p ?|-+[a-z-]+[ =]", m).end()
        return [(at + k, at + len(m))] if could_be(m[k:]) else []
    if kind == "element":
        k = m.index(">") + 1
        return [(at + k, at + len(m) - 2)] if asks(m[1 : k - 1]) and could_be(m[k:-2]) else []
    if kind == "told":
        v = re.search(r"[^\s\"']+$", m)
        value = v[0].rstrip(".,;:)")
        good = could_be(value, 7) and (token_like(value) or (re.search(r"\d", value) or _ODD_CASE.search(value)) and re.search(r"[A-Za-z]", value)) and not re.search(r"[(){}\[\]=:]", value)
        return [(at + v.start(), at + v.start() + len(value))] if good else []
    raise ValueError(kind)


#: A line of an armored key stands alone on its line.
_ALONE_BEFORE, _ALONE_AFTER = re.compile(r"(?:^|\n)[ \t]*$"), re.compile(r"[ \t\r]*(?:\n|$)")
_PROSE = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"\"\"|''')")


def spans(text: str | None) -> list[tuple[int, int]]:
    """Absolute, sorted, disjoint spans of the usable credentials of a text."""
    if not text:
        return []
    a, starts = automaton()
    found: set[tuple[int, int]] = set()
    memo: dict[tuple[int, int], dict[int, int]] = {}
    covered = (0, 0)  # the longest span yet
    run = 0  # end of the name that asks for no credential; nor do its endings
    for base in range(0, max(1, len(text) - OVERLAP), CHUNK - OVERLAP):
        for s in starts.finditer(text, base, base + CHUNK):
            p = s.start()
            for k, end in a.longest(text, p, memo).items():
                kind = IDS[k]
                if kind == "told":
                    line = text[max(base, text.rfind("\n", base, p) + 1) : p]
                    if not _PROSE.match(line) and not re.search(r"(?:#|(?<!:)//)[^\"']*$", line):
                        continue
                if kind == "key_line" and not (_ALONE_BEFORE.search(text[max(0, p - 80) : p]) and _ALONE_AFTER.match(text[end : end + 80])):
                    continue
                if covered[0] <= p and end <= covered[1]:
                    continue  # within a span that is found
                if kind == "bare" and (p < run or not ((head := _BARE_HEAD.match(text, p)) and asks(head[1]))):
                    run = max(run, head.end(1)) if p >= run and head else run
                    continue  # no credential by its name
                for span in judge(kind, text[p:end], p):
                    found.add(span)
                    covered = max(covered, span, key=lambda x: x[1] - x[0])
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        elif hi > lo:
            out.append((lo, hi))
    return out


def masked(text: str | None, where: list[tuple[int, int]] | None = None, placeholder: str = PLACEHOLDER) -> str | None:
    """The text with a placeholder in place of each credential."""
    if text is None:
        return None
    for lo, hi in reversed(spans(text) if where is None else where):
        text = text[:lo] + placeholder + text[hi:]
    return text


def scan(df: DataFrame, id_col: str, text_col: str, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``(id, n, masked)``: of each row the number of credentials and the redacted text. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for t in batch.column(1):
                t = t.as_py()
                where = spans(t)
                n.append(len(where))
                out.append(masked(t, where, placeholder))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(out, pa.string())], names=[id_col, "n", "masked"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n int, masked string")


def found(findings: DataFrame) -> DataFrame:
    """``(finding_id)`` of the findings whose snippet shows a usable credential; redelivered rows count once."""
    return scan(findings, "finding_id", "snippet").filter(F.col("n") > 0).select("finding_id").distinct()
