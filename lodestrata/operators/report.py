"""Report-time relations: what a report's tables and cards are made of.

Every function pre-aggregates before its shuffle; joins back are to keyed
aggregates, never to rows in groups. Null keys are their own group; nulls in
counted columns count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The domains that rule categories belong to in a compliance report.
DOMAINS = {"cryptography": "data protection", "data_exposure": "data protection", "secrets": "access", "authentication": "access", "session_mgmt": "access", "injection": "input", "io_validation": "input", "unsafe_exec": "input", "network_security": "network"}
#: What calls write logs, measure or trace.
OBSERVED = {"logging": r"\blog(?:ger|ging)?\.\w+\(|\bslog\.\w+\(|\bconsole\.(?:log|warn|error)\(|\btracing::|\b(?:info|warn|error|debug)!\(", "metrics": r"(?i)\b(?:prometheus|metrics?|statsd|counter|histogram)\.\w+\(", "tracing": r"(?i)\b(?:tracer|span|opentelemetry|otel)\.\w+\("}


def finding_owners(findings: DataFrame, churn: DataFrame, files: DataFrame) -> DataFrame:
    """Each finding with the busiest author of its file (left join: null where history has none)."""
    owner = files.select("file_id", "repo", "rel_path").join(churn.select("repo", "rel_path", F.substring_index("top_authors", ",", 1).alias("owner")), ["repo", "rel_path"]).select("file_id", "owner")
    return findings.join(owner, "file_id", "left")


def priority_issues(groups: DataFrame, top: int = 18) -> DataFrame:
    """The issues to mend first of each repo: severity, then hits, then id."""
    w = Window.partitionBy("repo").orderBy(F.desc("severity_rank"), F.desc("hits"), "rule_id")
    return groups.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def token_estimate(files: DataFrame, *keys: str) -> DataFrame:
    """Tokens a text may take, a fourth of its characters rounded up, summed by keys."""
    return files.groupBy(*keys).agg(F.sum(F.ceil(F.coalesce(F.length("content"), F.lit(0)) / 4)).cast("long").alias("tokens"), F.count("*").alias("files"))


def domain(category: Column | str) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in DOMAINS.items()), F.lit("other"))


def compliance(findings: DataFrame) -> DataFrame:
    """Findings and their high share by compliance domain. findings: category, severity."""
    high = (F.col("severity") == "HIGH").cast("int")
    return findings.groupBy(domain("category").alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg(high), 4).alias("high_share"))


def observability(lines: DataFrame) -> DataFrame:
    """Lines that log, measure or trace, by language and kind."""
    kinds = F.array_compact(F.array(*(F.when(F.col("raw").rlike(p), F.lit(k)) for k, p in OBSERVED.items())))
    hit = lines.filter(~F.col("comment")).select("file_id", "language_id", "line_no", F.explode_outer(kinds).alias("kind")).filter("kind IS NOT NULL").distinct()
    return hit.groupBy("language_id", "kind").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


def age(seconds: Column) -> Column:
    """How long ago in words: minutes, hours, days, months (30 days) or years (365 days), rounded down."""
    steps = ((365 * 86400, "y"), (30 * 86400, "mo"), (86400, "d"), (3600, "h"))
    out = F.concat(F.floor(seconds / 60).cast("string"), F.lit("min ago"))
    for size, unit in reversed(steps):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))).otherwise(out)
    return out


def shortened(text: str, most: int = 80) -> Column:
    """A text of at most ``most`` characters, with a mark where it was cut for display."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(F.col(text))


def language_mix(files: DataFrame) -> DataFrame:
    """Per repo its languages with their files, as text in the order of names: a map merged from partial counts."""
    n = files.filter("language_id IS NOT NULL").groupBy("repo", "language_id").agg(F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.concat_ws("=", "language_id", "n")))  # one entry a language
    return n.groupBy("repo").agg(F.concat_ws(",", parts).alias("mix"))


def package_grid(files: DataFrame) -> DataFrame:
    """Files and characters by repo and folder of the first level."""
    top = F.when(F.col("rel_path").contains("/"), F.substring_index("rel_path", "/", 1)).otherwise(F.lit(""))
    return files.groupBy("repo", top.alias("package")).agg(F.count("*").alias("files"), F.sum(F.coalesce(F.length("content"), F.lit(0))).cast("long").alias("chars"))


def doc_coverage(functions: DataFrame, *keys: str) -> DataFrame:
    """Share of documented functions; an unknown mark counts as none."""
    d = F.coalesce(F.col("documented"), F.lit(False)).cast("int")
    return functions.groupBy(*keys).agg(F.count("*").alias("functions"), F.sum(d).cast("long").alias("documented"), F.round(F.avg(d), 4).alias("share"))


def overlaid(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules with a user's severities in place of their own (rule_id, severity); 'off' takes a rule out."""
    o = overrides.select("rule_id", F.col("severity").alias("wanted"))
    j = rules.join(F.broadcast(o), "rule_id", "left")  # a user's list of rules, bounded by the rule table
    return j.withColumn("severity", F.coalesce("wanted", "severity")).filter("severity <> 'off'").drop("wanted")


def differing_metrics(then: DataFrame, now: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Metrics of both sides whose values differ."""
    a, b = then.select(name, F.col(value).alias("then")), now.select(name, F.col(value).alias("now"))
    return a.join(b, name).filter("then <> now")
