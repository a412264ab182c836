"""Then and now: comparing revisions, timelines, and the triage of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(then: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two keyed values: then, now and the difference (null where one side lacks the key)."""
    a, b = then.select(key, F.col(value).alias("then")), now.select(key, F.col(value).alias("now"))
    return a.join(b, key, "full_outer").withColumn("delta", F.col("now") - F.col("then"))


def diff_items(then: DataFrame, now: DataFrame, key: str = "item_key", size: str = "size") -> DataFrame:
    """Items new, resolved or grown; grown by at least max(3, a tenth of then)."""
    a, b = then.select(key, F.col(size).alias("then")), now.select(key, F.col(size).alias("now"))
    new = b.join(a, key, "left_anti").select(key, F.lit(None).cast("long").alias("then"), F.col("now").cast("long").alias("now"), F.lit("new").alias("state"))
    gone = a.join(b, key, "left_anti").select(key, F.col("then").cast("long").alias("then"), F.lit(None).cast("long").alias("now"), F.lit("resolved").alias("state"))
    grown = a.join(b, key).filter(F.col("now") - F.col("then") >= F.greatest(F.lit(3), F.floor(F.col("then") / 10))).select(key, F.col("then").cast("long").alias("then"), F.col("now").cast("long").alias("now"), F.lit("grown").alias("state"))
    return new.unionByName(gone).unionByName(grown)


def timeline(scores: DataFrame, *keys: str) -> DataFrame:
    """Legs between consecutive revisions: the change of value since the one before."""
    w = Window.partitionBy(*keys).orderBy("ts", "ref")
    return scores.withColumn("before", F.lag("value").over(w)).withColumn("delta", F.col("value") - F.col("before")).filter("before IS NOT NULL")


def read_first(changed: DataFrame, top: int = 5) -> DataFrame:
    """The files to read first: weights of findings, 3 a security and 2 a complexity finding, log2 of churn up to 6. changed: path, weight, security, complexity, churn."""
    score = F.col("weight") + 3 * F.col("security") + 2 * F.col("complexity") + F.least(F.lit(6), F.floor(F.log2(F.col("churn") + 1)))
    return changed.withColumn("score", F.round(score, 2)).orderBy(F.desc("score"), "path").limit(top)


def untested(changed: DataFrame, least: int = 10) -> DataFrame:
    """Changed source files with at least ``least`` added lines and no changed test of their stem or folder. changed: path, added, is_test."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1), r"(?i)(^test_|_test$|\.spec$|\.test$|Test$|_spec$)", "")
    c = changed.withColumn("stem", stem).withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", ""))
    tests = c.filter("is_test")
    return c.filter((~F.col("is_test")) & (F.col("added") >= least)).join(tests.select("stem").distinct(), "stem", "left_anti").join(tests.select("folder").distinct(), "folder", "left_anti").select("path", "added")


#: Risky statements of migrations: (pattern, unless).
MIGRATION = ((r"(?i)\bdrop\s+table\b", None), (r"(?i)\bdrop\s+column\b", None), (r"(?i)\btruncate\b", None), (r"(?i)\brename\s+(column|to)\b", None), (r"(?i)\badd\s+column\b.*\bnot\s+null\b", r"(?i)default"), (r"(?i)\balter\s+column\b.*\btype\b", None), (r"(?i)\bcreate\s+(unique\s+)?index\b", r"(?i)concurrently"), (r"(?i)\bdelete\s+from\b", r"(?i)where"), (r"(?i)\bupdate\s+\w+\s+set\b", r"(?i)where"))


def risky_migrations(added: DataFrame) -> DataFrame:
    """Added lines (path, line_no, raw) with a risky statement."""
    test = F.lit(False)
    for p, unless in MIGRATION:
        hit = F.col("raw").rlike(p)
        test = test | (hit if unless is None else hit & ~F.col("raw").rlike(unless))
    return added.filter(test)


def new_dependencies(base: DataFrame, head: DataFrame) -> DataFrame:
    """Dependencies (manifest, name, version) of head whose name base has not, and those whose version differs."""
    b = base.select("manifest", "name", F.col("version").alias("was")).distinct()
    j = head.join(b, ["manifest", "name"], "left")
    return j.filter("was IS NULL OR was <> version").withColumn("change", F.when(F.col("was").isNull(), "new").otherwise("version"))


def added_lines(hunks: DataFrame) -> DataFrame:
    """New lines of diff hunks (path, new_start, new_count, old_start): one row each with its place before."""
    h = hunks.filter("new_count > 0")
    return h.select("path", F.posexplode(F.sequence(F.col("new_start"), F.col("new_start") + F.col("new_count") - 1)).alias("k", "line_no"), "old_start").select("path", "line_no", (F.col("old_start") + F.col("k")).alias("old_line"))


def attach(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues on changed lines: (path, line_no, rule_id) joined with added lines."""
    return issues.join(changed.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi")


def change_summary(then: DataFrame, now: DataFrame) -> DataFrame:
    """Declarations (path, name, kind, digest) new, updated or deleted, counted by kind."""
    a, b = then.select("path", "name", "kind", F.col("digest").alias("was")), now.select("path", "name", "kind", F.col("digest").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "updated")
    return a.join(b, ["path", "name", "kind"], "full_outer").withColumn("state", state).filter("state IS NOT NULL").groupBy("kind", "state").agg(F.count("*").alias("n"))
