"""Rules as data, and plans that run all of them in one pass over the lines.

A rule is a row (rule_id, name, category, severity, cwe, languages, shape,
text, pattern, pattern2, skip, skip_tests). Shapes:

line     pattern found in the line (``text``: stripped or raw)
both     pattern and pattern2 found
without  pattern found, pattern2 not
guarded  first line with pattern, if pattern2 is nowhere in the file
paired   first line with pattern, if pattern2 is somewhere in the file
near     pattern found, pattern2 not within ``window`` lines before or after
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITY_WEIGHT = {"HIGH": 2.0, "MEDIUM": 1.0, "LOW": 0.5}
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    category: str
    severity: str
    pattern: str
    languages: tuple[str, ...] = ()
    shape: str = "line"
    pattern2: str | None = None
    text: str = "stripped"
    cwe: str | None = None
    skip: tuple[str, ...] = ()
    skip_tests: bool = False
    window: int = 3


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The rules as a small dimension table."""
    rows = [(r.rule_id, r.name, r.category, r.severity, r.cwe, list(r.languages), r.shape, r.text, r.pattern, r.pattern2, list(r.skip), r.skip_tests) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, name string, category string, severity string, cwe string, languages array<string>, shape string, text string, pattern string, pattern2 string, skip array<string>, skip_tests boolean")


def needed(pattern: str) -> tuple[str, ...]:
    """Literals one of which every match of a pattern holds, in lower case; none if that can't be told.

    Of the parts that a match must have, the one with the longest shortest literal is taken.
    """
    from re import _constants as C
    from re import _parser as P

    def of(tree) -> list[list[str]]:
        """Alternatives for each part that must be there."""
        out: list[list[str]] = []
        run = ""
        for op, arg in tree:
            if op is C.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if run:
                out.append([run])
                run = ""
            if op is C.SUBPATTERN:
                out += of(arg[3])
            elif op is C.BRANCH:
                parts = [best(of(part)) for part in arg[1]]
                if all(parts):
                    out.append([x for p in parts for x in p])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                out += of(arg[2])
        if run:
            out.append([run])
        return out

    def best(parts: list[list[str]]) -> list[str]:
        return max(parts, key=lambda p: min(map(len, p)), default=[])

    found = best(of(P.parse(pattern)))
    return tuple(dict.fromkeys(found)) if found and min(map(len, found)) > 1 and len(found) <= 8 else ()


def any_of(literals: Iterable[str]) -> str:
    """A pattern that finds any of some literals, with their common beginnings read once."""
    branches: dict[str, set[str]] = {}
    for x in literals:
        if not x:
            return ""
        branches.setdefault(x[0], set()).add(x[1:])
    parts = [re.escape(first) + any_of(rest) for first, rest in sorted(branches.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _worth(rules: list[Rule]):
    """Whether any of the rules can match a line: one pass over it for the literals that they need."""
    out = F.lit(False)
    for text in sorted({r.text for r in rules}):
        some = [r for r in rules if r.text == text]
        literals = {w for r in some for w in needed(r.pattern)}
        if literals:
            out = out | F.col(f"{text}_low").rlike(any_of(literals))
        for r in some:
            if not needed(r.pattern):
                out = out | F.col(text).rlike(r.pattern)
    return out


def quoted(s: str) -> str:
    """A text as a literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """Whether a line matches: the pattern runs only where a literal that it needs stands in the line's lower case."""
    words = " OR ".join(f"contains({text}_low, {quoted(w)})" for w in needed(pattern))
    return (f"({words}) AND " if words else "") + f"{text} RLIKE {quoted(pattern)}"


def _applies(r: Rule):
    ok = F.lit(True) if not r.languages else F.col("language_id").isin(*r.languages)
    if r.skip_tests:
        ok = ok & ~F.coalesce(F.col("is_test"), F.lit(False))
    return ok


def _hit(r: Rule) -> str:
    """The rule's id where it hits, as SQL: one text for all rules is read far faster than a column built call by call."""
    parts = [_matches(r.text, r.pattern)]
    if r.skip_tests:
        parts.append("NOT coalesce(is_test, false)")
    parts += [f"NOT contains({r.text}_low, {quoted(word.lower())})" for word in r.skip]
    if r.shape in ("both", "without"):
        parts.append(("NOT " if r.shape == "without" else "") + f"{r.text} RLIKE {quoted(r.pattern2)}")
    return f"CASE WHEN {' AND '.join(parts)} THEN {quoted(r.rule_id)} END"


def line_findings(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings of the one-line shapes: the strip is computed once and every rule is one expression of one projection.

    lines: file_id, language_id, is_test, line_no, raw, stripped, comment. Other
    columns are kept. No shuffle. Rules of other languages and patterns whose
    literals a line lacks cost it no match.
    """
    rules = [r for r in rules if r.shape in ("line", "both", "without")]
    by_language: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules:
        by_language.setdefault(r.languages, []).append(r)
    groups = []
    for languages, some in by_language.items():
        hits = f"array_compact(array({', '.join(map(_hit, some))}))"
        groups.append(f"CASE WHEN language_id IN ({', '.join(map(quoted, languages))}) THEN {hits} ELSE array() END" if languages else hits)
    code = lines.filter(~F.col("comment") & (F.trim("raw") != ""))
    low = code.withColumns({"raw_low": F.lower("raw"), "stripped_low": F.lower("stripped")}).filter(_worth(rules))
    # The hits are a column of their own: a generator evaluates its argument outside generated code.
    # Outer, then filtered: an inner explode has the optimizer push size(hits) > 0 below the
    # projection of ``stripped`` and compute every strip and rule twice.
    hits = low.withColumn("hits", F.expr(f"concat({', '.join(groups)})")).drop("raw_low", "stripped_low")
    return hits.withColumn("rule_id", F.explode_outer("hits")).filter("rule_id IS NOT NULL").drop("hits")


def file_findings(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings of the whole-file shapes: one aggregate for all rules, pre-aggregated before its shuffle."""
    rules = [r for r in rules if r.shape in ("guarded", "paired")]
    aggs = []
    for k, r in enumerate(rules):
        trigger = _applies(r) & ~F.col("comment") & F.col(r.text).rlike(r.pattern)
        aggs.append(F.min(F.when(trigger, F.struct("line_no", "raw"))).alias(f"t{k}"))
        aggs.append(F.max(F.coalesce(F.col(r.text).rlike(r.pattern2), F.lit(False))).alias(f"g{k}"))
    wide = lines.groupBy("file_id").agg(*aggs)
    wanted = [F.when(F.col(f"t{k}").isNotNull() & (~F.col(f"g{k}") if r.shape == "guarded" else F.col(f"g{k}")), F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"t{k}.line_no").alias("line_no"), F.col(f"t{k}.raw").alias("raw"))) for k, r in enumerate(rules)]
    return wide.select("file_id", F.explode(F.array_compact(F.array(*wanted))).alias("f")).select("file_id", "f.*")


def near_findings(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings of the windowed shape: a bounded look around, in the order of lines."""
    out = None
    for r in (r for r in rules if r.shape == "near"):
        w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(-r.window, r.window)
        near = F.max(F.coalesce(F.col(r.text).rlike(r.pattern2), F.lit(False))).over(w)
        hit = _applies(r) & ~F.col("comment") & F.col(r.text).rlike(r.pattern)
        part = lines.withColumn("near", near).filter(hit & ~F.col("near")).select("file_id", F.lit(r.rule_id).alias("rule_id"), "line_no", "raw")
        out = part if out is None else out.unionByName(part)
    return out


def capped(findings: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n findings of each rule (the feature of a report, with a full order)."""
    w = Window.partitionBy("rule_id").orderBy(*order)
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def severity_weight(severity: str = "severity"):
    return F.coalesce(*(F.when(F.col(severity) == k, F.lit(v)) for k, v in SEVERITY_WEIGHT.items()), F.lit(0.0))


def severity_rank(severity: str = "severity"):
    return F.coalesce(*(F.when(F.col(severity) == k, F.lit(v)) for k, v in SEVERITY_RANK.items()), F.lit(0))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or above."""
    return findings.filter(severity_rank() >= SEVERITY_RANK[severity])


def gate(findings: DataFrame, severity: str) -> bool:
    """Whether a build should fail: some finding of the severity or above exists. Stops at the first."""
    return not at_least(findings, severity).limit(1).isEmpty()


def issue_groups(issues: DataFrame) -> DataFrame:
    """Issues by rule: hits and files, the worst severity first."""
    g = issues.groupBy("rule_id", "severity").agg(F.count("*").alias("hits"), F.count_distinct("file_id").alias("files"))
    return g.withColumn("severity_rank", severity_rank())
