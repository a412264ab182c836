"""Inline suppression: directives become spans, and findings are anti-joined with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pattern of the directive, the lines it covers from its own (first, last; None: the whole file).
DIRECTIVES = (
    (r"#\s*(?:flake8|ruff):\s*noqa\b()", None, None),
    (r"#\s*noqa\b(?::\s*([A-Za-z0-9_., -]+))?", 0, 0),
    (r"pylint:\s*disable-next=([\w, -]+)", 1, 1),
    (r"pylint:\s*disable(?:-line)?=([\w, -]+)", 0, 0),
    (r"pylint:\s*skip-file()", None, None),
    (r"#\s*nosec\b:?\s*([\w, ]+)?", 0, 0),
    (r"//\s*nolint\b(?::\s*([\w, .-]+))?", 0, 1),
    (r"(?://|/\*)\s*eslint-disable-next-line\b\s*([\w@/, -]+)?", 1, 1),
    (r"(?://|/\*)\s*eslint-disable-line\b\s*([\w@/, -]+)?", 0, 0),
    (r"/\*\s*eslint-disable\s*([\w@/, -]+)?\*/", None, None),
    (r"\bNOSONAR\b()", 0, 0),
    (r"\bNOLINTNEXTLINE\b(?:\(([\w.,* -]+)\))?", 1, 1),
    (r"\bNOLINT\b(?:\(([\w.,* -]+)\))?", 0, 0),
    (r"@SuppressWarnings\(\s*\{?\s*\"([^)}]*)\"", 0, 1),
    (r"swiftlint:disable:next\s+([\w, ]+)", 1, 1),
)


def suppressions(lines: DataFrame) -> DataFrame:
    """``(file_id, from_line, to_line, names)``; an empty list of names covers every rule. to_line is null up to the end."""
    hits = []
    for pattern, first, last in DIRECTIVES:
        names = F.filter(F.transform(F.split(F.regexp_extract("raw", pattern, 1), r"[,\s\"]+"), F.lower), lambda x: x != "")
        a = F.lit(1) if first is None else F.col("line_no") + first
        b = F.lit(None).cast("int") if last is None else F.col("line_no") + last
        hits.append(F.when(F.col("raw").rlike(pattern), F.struct(a.alias("from_line"), b.alias("to_line"), names.alias("names"))))
    marked = lines.filter(F.col("raw").rlike(r"(?i)noqa|pylint|nosec|nolint|eslint-disable|NOSONAR|SuppressWarnings|swiftlint"))
    return marked.select("file_id", F.explode_outer(F.array_compact(F.array(*hits))).alias("s")).filter("s IS NOT NULL").select("file_id", "s.*")


def unsuppressed(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings that no span covers: an anti-join on the file with the span and the names as residual.

    A name covers a rule if it is the rule's id, or the part of it after the last dot or slash.
    """
    s = spans.select(F.col("file_id").alias("s_file"), "from_line", "to_line", "names")
    tail = F.lower(F.regexp_extract("rule_id", r"([^./]*)$", 1))
    inside = (F.col("line_no") >= F.col("from_line")) & (F.col("to_line").isNull() | (F.col("line_no") <= F.col("to_line")))
    named = (F.size("names") == 0) | F.array_contains("names", F.lower("rule_id")) | F.array_contains("names", tail)
    return findings.join(s, (F.col("file_id") == F.col("s_file")) & inside & named, "left_anti")
