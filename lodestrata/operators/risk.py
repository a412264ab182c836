"""Functions at risk: complexity, coverage and churn together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import base_name


def crap_score(ccn: Column, covered: Column) -> Column:
    """ccn^2 (1 - covered)^3 + ccn, to two places."""
    return F.round(ccn * ccn * F.pow(1 - covered, 3) + ccn, 2)


def coverage_of(functions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Share of covered lines of each function: an equi-join on the file with the line range as residual.

    functions: file_id, symbol, start_line, end_line. coverage: file_id, line_no, hit.
    Functions without measured lines count as not covered.
    """
    c = coverage.groupBy("file_id", "line_no").agg(F.max("hit").alias("hit")).withColumnRenamed("file_id", "c_file")
    j = functions.join(c, (F.col("file_id") == F.col("c_file")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left")
    return j.groupBy(*functions.columns).agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("covered"))


def rank(functions: DataFrame, weights: DataFrame, digits: int = 2) -> DataFrame:
    """CRAP and churn-weighted risk of each function.

    functions: file_id, repo, rel_path, symbol, start_line, ccn, covered. A file of a
    repo with history but no commits of its own weighs 0, one without any history 1.
    """
    known = weights.select("repo").distinct().withColumn("known", F.lit(True))
    j = functions.join(weights, ["repo", "rel_path"], "left").join(known, "repo", "left")
    w = F.coalesce("weight", F.when(F.col("known"), F.lit(0.0)).otherwise(F.lit(1.0)))
    return j.select("file_id", "symbol", "start_line", "ccn", crap_score(F.col("ccn").cast("double"), F.col("covered")).alias("crap"), F.round(F.col("ccn") * w, digits).alias("risk"))


def attach_by_suffix(artefact: DataFrame, files: DataFrame) -> DataFrame:
    """Coverage paths to files by their longest common ending; an ambiguous best match gives none.

    artefact: path. files: file_id, rel_path. Joined on the base name, scored by the
    number of equal last parts.
    """
    a = artefact.select("path").distinct().withColumn("base", base_name("path"))
    f = files.select("file_id", "rel_path").distinct().withColumn("base", base_name("rel_path"))
    x, y = F.reverse(F.split("path", "/")), F.reverse(F.split("rel_path", "/"))
    n = F.least(F.size(x), F.size(y))
    same = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, k: F.struct((s["n"] + F.when(s["on"] & (x[k] == y[k]), 1).otherwise(0)).alias("n"), (s["on"] & (x[k] == y[k])).alias("on")), lambda s: s["n"])
    scored = a.join(f, "base").withColumn("same", same)
    w = Window.partitionBy("path")
    best = scored.withColumn("best", F.max("same").over(w)).filter("same = best")
    return best.groupBy("path").agg(F.min("file_id").alias("file_id"), F.count("*").alias("ties")).filter("ties = 1").select("path", "file_id")


def enclosing(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """The innermost function around each finding (file_id, line_no): a range join and the latest start."""
    f = functions.select(F.col("file_id").alias("f_file"), "symbol", "start_line", "end_line")
    j = findings.join(f, (F.col("file_id") == F.col("f_file")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return j.groupBy(*findings.columns).agg(F.max_by("symbol", F.struct("start_line", "symbol")).alias("symbol"), F.max("start_line").alias("start_line"))


def worst_per_symbol(violations: DataFrame, order: str) -> DataFrame:
    """The worst violation of each (file_id, symbol), the first line on ties."""
    w = Window.partitionBy("file_id", "symbol").orderBy(F.desc(order), "start_line")
    return violations.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


#: Limits of function shape: (rule id, measure, limit).
SHAPE_LIMITS = (("shape-params", "params", 9), ("shape-nesting", "nesting", 5), ("shape-cyclomatic", "ccn", 10), ("shape-lines", "loc", 200))


def shape_issues(functions: DataFrame, limits=SHAPE_LIMITS) -> DataFrame:
    """Functions over a limit, one row for each limit: unpivoted in one pass."""
    over = F.array_compact(F.array(*(F.when(F.col(m) > n, F.struct(F.lit(r).alias("rule_id"), F.col(m).alias("value"))) for r, m, n in limits)))
    return functions.select("file_id", "symbol", "start_line", F.explode(over).alias("o")).select("file_id", "symbol", "start_line", "o.*")
