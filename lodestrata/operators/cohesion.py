"""Coupling and cohesion of types from their members.

members: (type_name, fields array<string>, methods array<struct<name string,
field_refs array<string>, param_types array<string>, external_refs array<string>>>).
All measures are higher-order functions on one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBERS = "type_name string, fields array<string>, methods array<struct<name:string, field_refs:array<string>, param_types:array<string>, external_refs:array<string>>>"


def measures(members: DataFrame) -> DataFrame:
    """CBO, LCOM (pairs without a shared field less pairs with one, 0 at least), LCOM4 (connected groups of methods), NLCOM and CAM."""
    m = F.col("methods")
    n = F.size(m)
    refs = F.transform(m, lambda x: F.array_intersect(x["field_refs"], F.col("fields")))
    index = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    shared = F.aggregate(index, F.lit(0), lambda acc, i: acc + F.size(F.filter(index, lambda j: (j > i) & F.arrays_overlap(F.element_at(refs, i + 1), F.element_at(refs, j + 1)))))
    pairs = n * (n - 1) / 2
    # connected groups: each method's fields are merged into the groups they touch
    groups = F.aggregate(
        refs,
        F.array().cast("array<array<string>>"),
        lambda acc, r: F.when(F.size(r) == 0, F.concat(acc, F.array(F.array(F.concat(F.lit("#"), F.size(acc).cast("string")))))).otherwise(
            F.concat(F.filter(acc, lambda g: ~F.arrays_overlap(g, r)), F.array(F.array_distinct(F.flatten(F.concat(F.filter(acc, lambda g: F.arrays_overlap(g, r)), F.array(r))))))
        ),
    )
    types = F.array_distinct(F.flatten(F.transform(m, lambda x: x["param_types"])))
    cam = F.when((n == 0) | (F.size(types) == 0), F.lit(1.0)).otherwise(F.aggregate(F.transform(m, lambda x: F.size(F.array_distinct(x["param_types"]))), F.lit(0), lambda a, x: a + x) / (n * F.size(types)))
    external = F.array_except(F.array_distinct(F.flatten(F.transform(m, lambda x: x["external_refs"]))), F.array("type_name"))
    lcom4 = F.size(groups)
    return members.select(
        "type_name",
        F.size(external).alias("cbo"),
        F.greatest(F.lit(0), pairs.cast("int") - 2 * shared).alias("lcom"),
        lcom4.alias("lcom4"),
        F.when(n > 1, F.round((lcom4 - 1) / (n - 1), 4)).otherwise(0.0).alias("nlcom"),
        F.round(cam, 4).alias("cam"),
    )
