"""Scores as expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import clamp, half_up
from lodestrata.operators.rules import severity_weight

#: Weights of the categories, 1000 with rounding, and the bands of the index.
CATEGORY_WEIGHTS = {
    "insecure_data_storage": 130, "crash_factors": 120, "cryptography": 110, "authentication": 100, "network_security": 90, "memory_corruption": 80, "io_validation": 80,
    "unsafe_deprecated": 60, "injection": 50, "data_exposure": 50, "binary_protections": 40, "platform_config": 40, "session_mgmt": 30, "unsafe_exec": 20,
}
BANDS = ((200, "Hardened"), (500, "Minor exposure"), (800, "Elevated risk"))


def category_scores(findings: DataFrame, files: int | Column) -> DataFrame:
    """Points of each category, from findings (category, severity): risk d / (d + 2) of the weighted density d,
    with a floor of one point while a category has a HIGH finding."""
    spark = findings.sparkSession
    weights = spark.createDataFrame([(k, v) for k, v in CATEGORY_WEIGHTS.items()], "category string, weight int")
    n = F.lit(files) if isinstance(files, int) else files
    agg = findings.groupBy("category").agg(F.count("*").alias("hits"), F.sum(severity_weight()).alias("weighted"), F.sum((F.col("severity") == "HIGH").cast("long")).alias("high"))
    out = weights.join(agg, "category", "left")
    d = F.coalesce(F.col("weighted"), F.lit(0.0)) / n
    points = F.greatest(half_up(d / (d + 2) * F.col("weight")), F.when(F.coalesce("high", F.lit(0)) > 0, F.least(F.col("high"), F.col("weight").cast("long"))).otherwise(0).cast("int"))
    return out.select("category", "weight", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"), points.alias("points"))


def danger_index(scores: DataFrame) -> DataFrame:
    """One row: the index from 0 to 1000 and its band."""
    total = clamp(F.sum("points"), 0, 1000).cast("int")
    band = F.lit("Critical exposure")
    for limit, name in reversed(BANDS):
        band = F.when(F.col("danger") < limit, name).otherwise(band)
    return scores.agg(total.alias("danger")).withColumn("band", band)


def curve(points: Column) -> Column:
    """5 + 95 e^(-p / 40), as an integer: a score that falls with penalty points."""
    return half_up(5 + 95 * F.exp(-points / 40))


def softened(x: Column) -> Column:
    return clamp(30 + F.floor(7 * x / 10), 5, 100).cast("int")


def overall(design: Column, quality: Column, security: Column, performance: Column) -> Column:
    return 0.25 * design + 0.30 * quality + 0.25 * security + 0.20 * performance


# Levels with the least score, and the least of the weakest dimension where one is asked.
LEVELS = (
    ("Trainee", 0, 0), ("Junior−", 20, 0), ("Junior", 32, 0), ("Junior+ / Middle−", 44, 0), ("Middle", 55, 0), ("Middle+ / Senior−", 63, 0), ("Senior", 70, 61), ("Senior+ / Lead−", 77, 70), ("Lead", 84, 75), ("Architect", 93, 99),
)


def ladder(score: Column, *dimensions: Column) -> Column:
    """The highest level whose least score is met and whose least dimension the weakest one meets; without dimensions scores alone count."""
    weakest = F.least(*dimensions) if len(dimensions) > 1 else dimensions[0] if dimensions else F.lit(100)
    out = F.lit(LEVELS[0][0])
    for level, need, floor in LEVELS[1:]:
        out = F.when((score >= need) & (weakest >= floor) if floor else score >= need, level).otherwise(out)
    return out


def check_health(checks: DataFrame, *keys: str) -> DataFrame:
    """Severity-weighted share of passed checks: pass 1, warn one half, fail 0, na left out."""
    w = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in {"critical": 10, "high": 5, "medium": 2, "low": 1}.items()), F.lit(1))
    value = F.coalesce(*(F.when(F.col("status") == k, F.lit(v)) for k, v in {"pass": 1.0, "warn": 0.5, "fail": 0.0}.items()))
    rated = checks.filter(F.col("status").isin("pass", "warn", "fail"))
    return rated.groupBy(*keys).agg(F.count("*").alias("checks"), half_up(100 * F.sum(value * w) / F.sum(w)).alias("health"))
