"""Resources acquired more often than released, per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.rule_tables import LEAKS
from lodestrata.operators.rules import quoted


def leaks(lines: DataFrame, rules=LEAKS) -> DataFrame:
    """(file_id, rule_id, line_no, raw): all acquire lines of files with acquires > floor(releases * ratio) + margin.

    Lines may come from several deliveries of a file; a line counts once.
    One pass marks lines, one aggregate counts every rule of a file; the join back is on (file_id, rule_id).
    """
    marks = []
    for rule_id, _, langs, acquire, release, _, _ in rules:
        a, r = (f"stripped RLIKE {quoted(p)}" for p in (acquire, release))
        marks.append(f"CASE WHEN language_id IN ({', '.join(map(quoted, langs))}) AND ({a} OR {r}) THEN named_struct('rule_id', {quoted(rule_id)}, 'acquire', {a}, 'release', {r}) END")
    # a column of its own, since a generator evaluates its argument outside generated code
    marked = lines.filter(~F.col("comment")).select("file_id", "line_no", "raw", F.expr(f"array_compact(array({', '.join(marks)}))").alias("marks"))
    hit = marked.select("file_id", "line_no", "raw", F.explode_outer("marks").alias("m")).filter("m IS NOT NULL").select("file_id", "line_no", "raw", "m.*").dropDuplicates(["file_id", "rule_id", "line_no"])
    n = hit.groupBy("file_id", "rule_id").agg(F.sum(F.col("acquire").cast("int")).alias("a"), F.sum(F.col("release").cast("int")).alias("r"))
    ratio = F.coalesce(*(F.when(F.col("rule_id") == x[0], F.lit(x[5])) for x in rules))
    margin = F.coalesce(*(F.when(F.col("rule_id") == x[0], F.lit(x[6])) for x in rules))
    over = n.filter(F.col("a") > F.floor(F.col("r") * ratio) + margin).select("file_id", "rule_id")
    return hit.filter("acquire").join(over, ["file_id", "rule_id"], "left_semi").select("file_id", "rule_id", "line_no", "raw")
