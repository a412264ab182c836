"""Rules that look at the lines around a line: one ordered window over a file's lines.

A file is one record of the tables, so a window over its lines holds one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _w():
    return Window.partitionBy("file_id").orderBy("line_no")


def brace_depth(lines: DataFrame) -> DataFrame:
    """Lines with ``depth``: the braces open before the line, counted in stripped text."""
    n = F.length("stripped") - F.length(F.regexp_replace("stripped", r"\{", ""))
    m = F.length("stripped") - F.length(F.regexp_replace("stripped", r"\}", ""))
    step = F.when(F.col("comment"), 0).otherwise(n - m)
    return lines.withColumn("depth", F.coalesce(F.sum(step).over(_w().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def next_line(lines: DataFrame, first: str, second: str) -> DataFrame:
    """Lines that match ``first`` and are followed by one that matches ``second``, both stripped; comments and blank lines don't count."""
    s = lines.filter(~F.col("comment") & (F.trim("stripped") != "")).withColumn("next", F.lead("stripped").over(_w()))
    return s.filter(F.col("stripped").rlike(first) & F.col("next").rlike(second))


def unpaired(lines: DataFrame, acquire: str, release: str, behind: int = 2, ahead: int = 3) -> DataFrame:
    """Lines that acquire without a release within ``behind`` lines before or ``ahead`` after."""
    near = F.max(F.col("stripped").rlike(release)).over(_w().rowsBetween(-behind, ahead))
    return lines.withColumn("near", near).filter(~F.col("comment") & F.col("stripped").rlike(acquire) & ~F.col("near")).drop("near")


def gated(lines: DataFrame, gate: str, pattern: str) -> DataFrame:
    """Lines that match a pattern, in files some line of which matches the gate: a semi-join of file ids."""
    files = lines.filter(F.col("raw").rlike(gate)).select("file_id").distinct()
    return lines.filter(~F.col("comment") & F.col("stripped").rlike(pattern)).join(files, "file_id", "left_semi")
