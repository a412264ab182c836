"""Duplicated blocks: windows of lines by hash, maximal runs by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(lines: DataFrame, size: int = 6, min_chars: int = 110) -> DataFrame:
    """(file_id, seq, line_no, h): hash of each ``size`` consecutive significant lines with enough characters.

    lines: file_id, line_no, raw. Blank and comment-free comparison is on trimmed text.
    """
    sig = lines.filter(F.length(F.trim("raw")) > 1).select("file_id", "line_no", F.trim("raw").alias("t"))
    w = Window.partitionBy("file_id").orderBy("line_no")
    parts = [F.col("t"), *(F.lead("t", k).over(w) for k in range(1, size))]
    seq = sig.select("file_id", "line_no", F.row_number().over(w).alias("seq"), F.concat_ws("\n", *parts).alias("block"), F.lead("t", size - 1).over(w).isNotNull().alias("whole"))
    return seq.filter(F.col("whole") & (F.length("block") >= min_chars)).select("file_id", "seq", "line_no", F.xxhash64("block").alias("h"))


def duplicated(lines: DataFrame, size: int = 6, min_chars: int = 110, min_lines: int = 15) -> DataFrame:
    """Maximal runs of significant lines whose windows all occur in another place.

    (file_id, first_line, last_line, lines). No pairs are formed: a window counts
    as repeated by its number of places, so a block with many copies costs no more.
    """
    w = windows(lines, size, min_chars)
    many = w.groupBy("h").agg(F.count("*").alias("places")).filter("places > 1").select("h")
    hit = w.join(many, "h", "left_semi")
    by = Window.partitionBy("file_id").orderBy("seq")
    island = hit.select("file_id", "seq", "line_no", (F.col("seq") - F.row_number().over(by)).alias("island"))
    runs = island.groupBy("file_id", "island").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.min("line_no").alias("first_line"))
    return runs.withColumn("lines", (F.col("b") - F.col("a") + size).cast("int")).filter(F.col("lines") >= min_lines).select("file_id", "first_line", "lines")


def identical(files: DataFrame, text_col: str = "content", key: str = "file_id") -> DataFrame:
    """Groups of equal texts: a digest, the least key and the number of keys. Pre-aggregated."""
    return files.filter(F.length(text_col) > 0).select(key, F.sha2(text_col, 256).alias("digest")).distinct().groupBy("digest").agg(F.min(key).alias("first_key"), F.count("*").alias("copies")).filter("copies > 1")
