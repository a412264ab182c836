"""Text functions as column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One left-to-right pass over a line: literals keep their quotes and lose their content, comments go.
_STRIP = r"""//.*$|#.*$|(")(?:\\.|[^"\\])*+("|$)|(')(?:\\.|[^'\\])*+('|$)|(`)[^`]*+(`|$)"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(line: Column | str) -> Column:
    """A line without comments and without the contents of its literals."""
    return F.regexp_replace(col(line), _STRIP, "$1$2$3$4$5$6")


def is_comment(line: Column | str) -> Column:
    """Whether a line is nothing but a comment."""
    return F.ltrim(col(line)).rlike(r"^(//|#|\*|/\*)")


def indent(line: Column | str) -> Column:
    """Leading blanks, a tab counting as four."""
    return F.length(F.regexp_replace(F.regexp_extract(col(line), r"^[ \t]*", 0), "\t", "    "))


def entropy(text: Column | str) -> Column:
    """Shannon entropy of a text in bits a character; 0 for the empty text."""
    chars = F.filter(F.split(col(text), ""), lambda c: F.length(c) > 0)
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def name_parts(name: Column | str) -> Column:
    """Lower-case words of a camelCase, PascalCase or snake_case name."""
    spaced = F.regexp_replace(F.regexp_replace(col(name), r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def route_key(path: Column | str) -> Column:
    """A route with its parameters made alike: {id}, :id, <id> and ${id} become {}."""
    p = F.regexp_replace(col(path), r"[?#].*$", "")
    p = F.regexp_replace(p, r"\$?\{[^/{}]*\}|:[A-Za-z_]\w*|<[^/<>]*>", "{}")
    return F.lower(F.regexp_replace(F.regexp_replace(p, r"/+$", ""), r"^$", "/"))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def folder(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def ancestors(path: Column | str) -> Column:
    """All folders above a path, the nearest last; makes longest-prefix joins equi-joins."""
    parts = F.split(folder(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def semver(tag: Column | str) -> Column:
    """(major, minor, patch) of a version tag, or null."""
    t = col(tag)
    p = r"^v?(\d+)\.(\d+)(?:\.(\d+))?"
    part = lambda k: F.coalesce(F.expr("try_cast(null as int)"), F.when(F.regexp_extract(t, p, k) != "", F.regexp_extract(t, p, k).cast("int")))
    return F.when(t.rlike(p), F.struct(part(1).alias("major"), part(2).alias("minor"), F.coalesce(part(3), F.lit(0)).alias("patch")))


def masked_url(url: Column | str) -> Column:
    """A URL without the password in it."""
    return F.regexp_replace(col(url), r"(://[^:/@\s]*):[^@/\s]+@", "$1:***@")


def half_up(x: Column) -> Column:
    """floor(x + 0.5) as an integer, for numbers from 0 on."""
    return F.floor(x + 0.5).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
