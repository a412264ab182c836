"""Writing results: SARIF, Markdown, JSON and Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = {"HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
SCORE = {"HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0"}


def _mapped(values: dict[str, str], name: str):
    return F.coalesce(*(F.when(F.col(name) == k, F.lit(v)) for k, v in values.items()), F.lit("none"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result object for each finding (rule_id, severity, name, path, line_no, snippet): built as expressions, distributed."""
    region = F.struct(F.greatest(F.col("line_no"), F.lit(1)).alias("startLine"), F.struct(F.coalesce("snippet", F.lit("")).alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), _mapped(LEVEL, "severity").alias("level"), F.struct(F.coalesce("name", "rule_id").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(_mapped(SCORE, "severity").alias("security-severity")).alias("properties"))
    return findings.select("rule_id", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "lodestrata") -> int:
    """One SARIF 2.1.0 file; results stream through the driver partition by partition. The number of results."""
    rules = [r["rule_id"] for r in findings.select("rule_id").distinct().orderBy("rule_id").collect()]  # one row a rule
    driver = {"name": tool, "rules": [{"id": r} for r in rules]}
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":' + json.dumps(driver) + '},"results":[')
        for row in sarif_results(findings).select("result").toLocalIterator():
            out.write(("," if n else "") + row["result"])
            n += 1
        out.write("]}]}")
    return n


def markdown(df: DataFrame, title: str, top: int = 100) -> str:
    """A Markdown table of a small ordered report (a top-k feature)."""
    rows = df.limit(top).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def write(df: DataFrame, path: str, kind: str = "parquet", *partitions: str) -> None:
    """Parquet, ORC, JSON or CSV, partitioned if asked."""
    w = df.write.mode("overwrite")
    if partitions:
        w = w.partitionBy(*partitions)
    w.format(kind).save(path)
