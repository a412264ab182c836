"""History: authors, churn, activity and the habits of a repository's commits.

All aggregates pre-aggregate before their shuffle. Repeated rows of a commit or
of a commit's file count once; nulls in author are their own author "".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def micros(name: str):
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def seconds(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))


CONVENTIONAL = r"^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]*\))?!?: "
WEEKS = 76


def commits_once(commits: DataFrame) -> DataFrame:
    """One row for each (repo, sha); of rows that differ the least by author, time and subject."""
    return commits.groupBy("repo", "sha").agg(F.min(F.struct("ts", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("subject", F.lit("")).alias("subject"), "is_merge")).alias("c")).select("repo", "sha", "c.*")


def touches(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commits that are no merges, joined with their distinct files; binary files have no counts and add nothing."""
    files = commit_files.groupBy("repo", "sha", "rel_path").agg(F.max(F.coalesce("added", F.lit(0))).alias("added"), F.max(F.coalesce("deleted", F.lit(0))).alias("deleted"))
    return files.join(commits_once(commits).filter(~F.coalesce(F.col("is_merge"), F.lit(False))), ["repo", "sha"])


def author_stats(touched: DataFrame) -> DataFrame:
    """Per repo and author: commits, first and last time, lines added, distinct files."""
    # two steps: distinct commits and files are counted without a hash set of them in memory
    return touched.groupBy("repo", "author").agg(
        F.count_distinct("sha").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("added").cast("long").alias("added"), F.count_distinct("rel_path").alias("files")
    )


def churn(touched: DataFrame) -> DataFrame:
    """Per file the changes, and its three busiest authors in order."""
    per = touched.groupBy("repo", "rel_path", "author").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo", "rel_path").orderBy(F.desc("n"), "author")
    top = per.withColumn("k", F.row_number().over(w)).groupBy("repo", "rel_path").agg(
        F.sum("n").cast("long").alias("changes"), F.count("*").alias("authors"), F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "author")))).alias("t")
    )
    return top.select("repo", "rel_path", "changes", "authors", F.concat_ws(",", F.transform("t", lambda x: x["author"])).alias("top_authors"))


def churn_weight(touched: DataFrame) -> DataFrame:
    """Per file the sum of logistic recency weights of its changes: 1 / (1 + e^(12 - 12 t)), t from 0 (first) to 1 (last) of its repo."""
    bounds = touched.groupBy("repo").agg(F.min(micros("ts")).alias("lo"), F.max(micros("ts")).alias("hi"))
    t = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((micros("ts") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    w = 1 / (1 + F.exp(-12 * t + 12))
    return touched.join(bounds, "repo").groupBy("repo", "rel_path").agg(F.round(F.sum(w), 4).alias("weight"))


def weekly(touched: DataFrame) -> DataFrame:
    """Touches by repo, lower-case extension and week of the window of WEEKS weeks that ends with the repo's last commit.

    Weeks count forward from the window's begin, the oldest 0; paths without an extension don't count.
    """
    last = touched.groupBy("repo").agg(F.max("ts").alias("last_ts"))
    week = (F.lit(WEEKS - 1) - F.floor((seconds("last_ts") - seconds("ts")) / (7 * 86400))).cast("int")
    ext = F.lower(F.regexp_extract("rel_path", r"\.([A-Za-z0-9]+)$", 1))
    return touched.join(last, "repo").select("repo", ext.alias("ext"), week.alias("week")).filter((F.col("week") >= 0) & (F.col("ext") != "")).groupBy("repo", "ext", "week").agg(F.count("*").alias("touches"))


def calendar_anomalies(weeks: DataFrame) -> DataFrame:
    """Weeks above q3 + 3 (q3 - q1) of the repo's non-zero weeks, quartiles without interpolation, from four weeks on."""
    per = weeks.groupBy("repo", "week").agg(F.sum("touches").cast("long").alias("touches"))
    s = per.groupBy("repo").agg(F.sort_array(F.collect_list("touches")).alias("v")).filter(F.size("v") >= 4)
    n = F.size("v")
    s = s.select("repo", F.element_at("v", (F.floor(n / 4) + 1).cast("int")).alias("q1"), F.element_at("v", (F.floor(3 * n / 4) + 1).cast("int")).alias("q3"))
    return per.join(s, "repo").filter((F.col("q3") > F.col("q1")) & (F.col("touches") > F.col("q3") + 3 * (F.col("q3") - F.col("q1")))).select("repo", "week", "touches")


def hygiene(commits: DataFrame) -> DataFrame:
    """Per repo: commits, merges, and of the others the conventional subjects and their share."""
    c = commits_once(commits)
    merge = F.coalesce(F.col("is_merge"), F.lit(False))
    conv = F.when(~merge, F.col("subject").rlike(CONVENTIONAL).cast("long"))
    return c.groupBy("repo").agg(F.count("*").alias("commits"), F.sum(merge.cast("long")).alias("merges"), F.coalesce(F.sum(conv), F.lit(0)).alias("conventional"), F.round(F.coalesce(F.avg(conv), F.lit(0.0)), 4).alias("share"))


def subject_types(commits: DataFrame) -> DataFrame:
    """Subjects by the word before their colon or, without one, their first word."""
    kind = F.lower(F.regexp_extract("subject", r"^([A-Za-z]+)", 1))
    return commits_once(commits).filter(~F.coalesce(F.col("is_merge"), F.lit(False))).groupBy("repo", kind.alias("kind")).agg(F.count("*").alias("n"))


def co_change(touched: DataFrame) -> DataFrame:
    """Files changed together with each file's most frequent partner folder.

    Pairs are counted between a file and a folder of the same commit, not between
    all files, so a commit of n files gives n times its folders, not n squared.
    """
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    one = touched.select("repo", "sha", "rel_path", folder.alias("folder"))
    dirs = one.select("repo", "sha", F.col("folder").alias("other")).distinct()
    pairs = one.join(dirs, ["repo", "sha"]).filter("folder <> other").groupBy("repo", "rel_path", "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo", "rel_path").orderBy(F.desc("n"), "other")
    return pairs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def branching_model(stats: DataFrame) -> DataFrame:
    """Per repo the likeliest branching habit, from its merge share and tempo; confidence is the top weight's share."""
    m = F.col("merges") / F.greatest(F.col("commits"), F.lit(1))
    weights = F.array(
        F.struct(F.when(m < 0.05, 3).when(m < 0.15, 1).otherwise(0).alias("w"), F.lit("trunk").alias("model")),
        F.struct(F.when((m >= 0.05) & (m < 0.3), 3).otherwise(1).alias("w"), F.lit("feature branches").alias("model")),
        F.struct(F.when(m >= 0.3, 3).otherwise(0).alias("w"), F.lit("release branches").alias("model")),
    )
    best = F.reverse(F.array_sort(weights))[0]
    total = F.aggregate(weights, F.lit(0), lambda a, x: a + x["w"])
    return stats.select("repo", best["model"].alias("model"), F.round(best["w"] / total, 4).alias("confidence"))


def as_of(commits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The last commit of each repo at or before each of its cutoffs (repo, cutoff)."""
    c = commits_once(commits)
    j = cutoffs.join(c, "repo").filter(F.col("ts") <= F.col("cutoff"))
    return j.groupBy("repo", "cutoff").agg(F.max(F.struct("ts", "sha")).alias("m")).select("repo", "cutoff", "m.sha", "m.ts")
