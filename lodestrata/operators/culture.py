"""Dimension scores of a platform as expressions over one row of its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import clamp, half_up
from lodestrata.operators.scoring import curve, ladder, overall


def ramp(values: tuple[int, ...], n: Column) -> Column:
    """The n-th value of a ramp, its last one beyond the end."""
    return F.element_at(F.array(*map(F.lit, values)), (F.least(n, F.lit(len(values) - 1)) + 1).cast("int"))


#: Points for the number of data structures and of algorithms.
STRUCTURE_RAMP = (0, 40, 50, 55, 60, 66, 70, 80, 82, 86, 90)
ALGORITHM_RAMP = (0, 50, 58, 66, 80, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99, 100)


def long_functions(god: Column, longest: Column, todos: Column, kloc: Column) -> Column:
    k = F.greatest(kloc, F.lit(0.1))
    worst = F.when(longest > 600, 18).when(longest > 300, 9).when(longest > 150, 3).otherwise(0)
    pen = 10 * god / k + worst + 2.5 * todos / k
    pen = F.when(god <= 3, F.least(pen, F.lit(20.0))).otherwise(pen)
    return clamp(100 - F.floor(pen + 0.5), 5, 100).cast("int")


def security(high: Column, medium: Column, traffic: Column | None = None) -> Column:
    own = curve(7 * high + 2 * medium)
    return own if traffic is None else half_up(0.7 * own + 0.3 * traffic)


def complexity(cubes: Column, squares: Column) -> Column:
    """80 where nothing is penalised, else the curve of 7 per cubic and 2 per quadratic function."""
    return F.when((cubes == 0) & (squares == 0), F.lit(80)).otherwise(curve(7 * cubes + 2 * squares))


def rows(measures: DataFrame) -> DataFrame:
    """Dimensions, overall score and level of each row (kloc, structures, algorithms, god, longest, todos, issue_points, high, medium, cubes, squares, leaks, design)."""
    c = F.col
    quality = half_up(0.17 * ramp(STRUCTURE_RAMP, c("structures")) + 0.13 * ramp(ALGORITHM_RAMP, c("algorithms")) + 0.20 * long_functions(c("god"), c("longest"), c("todos"), c("kloc")) + 0.50 * clamp(100 - F.least(F.lit(15.0), c("issue_points") / F.greatest(c("kloc"), F.lit(0.1))), 5, 100))
    performance = half_up(0.85 * complexity(c("cubes"), c("squares")) + 0.15 * curve(4 * c("leaks")))
    m = measures.withColumn("quality", quality).withColumn("security", security(c("high"), c("medium"))).withColumn("performance", performance)
    m = m.withColumn("overall", F.round(overall(c("design"), c("quality"), c("security"), c("performance")), 2))
    return m.withColumn("level", ladder(c("overall"), c("design"), c("quality"), c("security"), c("performance")))


def repo_level(platforms: DataFrame, *keys: str) -> DataFrame:
    """Mean of platform scores weighted by lines, by integer division."""
    return platforms.groupBy(*keys).agg(F.floor(F.sum(F.floor("overall") * F.col("loc")) / F.sum("loc")).cast("int").alias("overall"))
