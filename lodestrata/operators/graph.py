"""Graphs of modules: degrees, instability, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.tables import cut


def edges_once(edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) without loops and nulls."""
    return edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Of each node: Ca (incoming), Ce (outgoing) and instability Ce / (Ca + Ce)."""
    e = edges_once(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("ca"), F.lit(1).alias("ce")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("ca"), F.lit(0).alias("ce")))
    g = ends.groupBy("node").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    return g.withColumn("instability", F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 4))


#: Graphs of at most so many edges (checked by a count) are ranked in the driver's memory: 16 bytes an edge.
MAX_LOCAL_EDGES = 200_000


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 40, max_local_edges: int = MAX_LOCAL_EDGES) -> DataFrame:
    """(node, rank): a fixed number of rounds, the mass of nodes without outgoing edges spread evenly.

    A graph of modules is small and is ranked in memory after its size is checked.
    Above that, ranks are joined to edges by source and summed by target,
    pre-aggregated; every round is written to the shared checkpoint folder, so
    plans stay of one size.
    """
    e = cut(edges_once(edges))
    if e.limit(max_local_edges + 1).count() <= max_local_edges:
        return _ranked_locally(e, damping, rounds)
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(e.join(out, "src"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    leaf = cut(nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out").isNull().alias("leaf")))
    n = leaf.count()
    ranks = leaf.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("leaf"), F.col("rank"))), F.lit(0.0))).first()[0]  # one number
        given = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        ranks = cut(leaf.join(given.withColumnRenamed("dst", "node"), "node", "left").select("node", "leaf", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + lost / n)).alias("rank")))
    return ranks.select("node", "rank")


def _ranked_locally(e: DataFrame, damping: float, rounds: int) -> DataFrame:
    import numpy as np

    rows = e.collect()
    names = sorted({x for r in rows for x in r})
    place = {x: k for k, x in enumerate(names)}
    n = len(names)
    kind = e.schema["src"].dataType.simpleString()
    if not n:
        return e.sparkSession.createDataFrame([], f"node {kind}, rank double")
    src, dst = (np.fromiter((place[r[k]] for r in rows), int, len(rows)) for k in (0, 1))
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        given = np.bincount(dst, rank[src] / out[src], minlength=n)
        rank = (1 - damping) / n + damping * (given + rank[out == 0].sum() / n)
    return e.sparkSession.createDataFrame(list(zip(names, rank.tolist(), strict=True)), f"node {kind}, rank double")


def hotspots(edges: DataFrame, top: int = 15) -> DataFrame:
    """The top nodes by PageRank, then incoming edges, then name."""
    r = pagerank(edges).join(degrees(edges), "node").withColumn("rank", F.round("rank", 8))
    return r.orderBy(F.desc("rank"), F.desc("ca"), "node").limit(top)


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges from imports (module, import_name) to known modules (module): the whole name, else its first part, else its last."""
    known = modules.select(F.col("module").alias("dst")).distinct()
    whole = known.withColumnRenamed("dst", "by_whole")
    first = known.withColumnRenamed("dst", "by_first")
    last = known.withColumnRenamed("dst", "by_last")
    i = imports.withColumn("first", F.regexp_extract("import_name", r"^([^./:]+)", 1)).withColumn("last", F.regexp_extract("import_name", r"([^./:]+)$", 1))
    j = i.join(whole, F.col("import_name") == F.col("by_whole"), "left").join(first, F.col("first") == F.col("by_first"), "left").join(last, F.col("last") == F.col("by_last"), "left")
    return j.select(F.col("module").alias("src"), F.coalesce("by_whole", "by_first", "by_last").alias("dst")).filter("dst IS NOT NULL")
