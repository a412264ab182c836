"""Files to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import is_comment, stripped


def file_lines(text_col: str = "content"):
    """The lines of a text as an array."""
    return F.split(F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n\\z", ""), "\n")


def lines(files: DataFrame, text_col: str = "content", *keep: str) -> DataFrame:
    """One row for each line: the kept columns, line_no from 1 and raw.

    A newline at the end makes no further line; carriage returns go. Null texts
    give no rows, an empty text none. The explode is narrow: no shuffle.
    """
    return files.filter(F.length(text_col) > 0).select(*keep, F.posexplode(file_lines(text_col)).alias("pos", "raw")).select(*keep, (F.col("pos") + 1).alias("line_no"), "raw")


def code_lines(files: DataFrame, text_col: str = "content", *keep: str) -> DataFrame:
    """Lines with ``stripped`` (no comments, no literal contents) and ``comment``."""
    return lines(files, text_col, *keep).withColumn("stripped", stripped("raw")).withColumn("comment", is_comment("raw"))


def distinct_files(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Redelivered rows once: rows of a key agree but for ingested_at."""
    return files.dropDuplicates([key])
