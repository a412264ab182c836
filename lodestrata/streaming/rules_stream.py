"""The stateless rule plan and windowed counts over streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.rules import Rule, line_findings
from lodestrata.sources.lines import code_lines


def stream_findings(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings of a stream of files (file_id, language_id, is_test, content): stateless, so output is append only."""
    lines = code_lines(files, "content", "file_id", "language_id", "is_test")
    return line_findings(lines, rules).select("file_id", "rule_id", "line_no", F.trim("raw").alias("snippet"))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", *keys: str) -> DataFrame:
    """Events by window and key; rows later than the watermark are dropped by contract."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Redelivered rows once, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
