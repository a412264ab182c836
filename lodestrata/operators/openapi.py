"""API descriptions: operations out of documents, lint rules, and the differences of two versions.

Documents come as trees of nodes (sources/yaml_nodes.py); everything after the
parser is joins and aggregates over those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import route_key

VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
_OP = r"^\$\.paths\['((?:[^'\\]|\\.)*)'\]\.(get|put|post|delete|options|head|patch|trace)$"


def operations(nodes: DataFrame) -> DataFrame:
    """(doc_id, verb, path, key, line_no) of the operations of each document."""
    o = nodes.filter(F.col("json_path").rlike(_OP)).select("doc_id", F.upper(F.regexp_extract("json_path", _OP, 2)).alias("verb"), F.regexp_extract("json_path", _OP, 1).alias("path"), "line_no")
    return o.withColumn("key", route_key("path"))


def _children(nodes: DataFrame) -> DataFrame:
    """Values under each operation: (doc_id, path, verb, field, value)."""
    p = r"^\$\.paths\['((?:[^'\\]|\\.)*)'\]\.(get|put|post|delete|options|head|patch|trace)\.(.+)$"
    return nodes.filter(F.col("json_path").rlike(p)).select("doc_id", F.regexp_extract("json_path", p, 1).alias("path"), F.upper(F.regexp_extract("json_path", p, 2)).alias("verb"), F.regexp_extract("json_path", p, 3).alias("field"), "value", "kind")


#: Lint rules on operations: (id, severity, text). Each is a condition over what an operation has.
LINT = (
    ("operation-summary", "LOW", "operation without a summary"), ("operation-description", "LOW", "operation without a description"), ("operation-id", "MEDIUM", "operation without an operationId"), ("operation-tags", "LOW", "operation without tags"),
    ("operation-success", "HIGH", "operation without a 2xx or 3xx response"), ("operation-4xx", "LOW", "operation without a 4xx response"), ("operation-security", "MEDIUM", "operation without security"), ("get-body", "MEDIUM", "GET or HEAD with a request body"),
    ("path-trailing-slash", "LOW", "path with a slash at its end"), ("path-query", "HIGH", "path with a query string"), ("path-case", "LOW", "path with capitals"), ("path-parameter", "HIGH", "path parameter that is not declared"), ("operation-deprecated", "LOW", "deprecated operation"),
)


def lint(nodes: DataFrame) -> DataFrame:
    """(doc_id, path, verb, rule_id, severity). Duplicate operationIds of a document come under operation-id-unique."""
    ops = operations(nodes).select("doc_id", "path", "verb")
    c = _children(nodes)
    has = lambda cond: F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1
    f = F.col("field")
    facts = c.groupBy("doc_id", "path", "verb").agg(
        has(f == "summary").alias("summary"), has(f == "description").alias("description"), has(f == "operationId").alias("oid"), has(f.startswith("tags")).alias("tags"), has(f.rlike(r"^responses(\.|\[')[23]")).alias("ok"), has(f.rlike(r"^responses(\.|\[')4")).alias("c4"),
        has(f.startswith("security")).alias("sec"), has(f.startswith("requestBody")).alias("body"), has((f == "deprecated") & (F.col("value") == "true")).alias("deprecated"), F.collect_set(F.when(f.rlike(r"^parameters\[\d+\]\.name$"), F.col("value"))).alias("params"),
    )
    o = ops.join(facts, ["doc_id", "path", "verb"], "left")
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    wanted = F.regexp_extract_all("path", F.lit(r"\{([^}]+)\}"), F.lit(1))
    tests = {
        "operation-summary": no("summary"), "operation-description": no("description"), "operation-id": no("oid"), "operation-tags": no("tags"), "operation-success": no("ok"), "operation-4xx": no("c4"), "operation-security": no("sec"),
        "get-body": F.col("verb").isin("GET", "HEAD") & yes("body"), "path-trailing-slash": F.col("path").rlike(r".+/$"), "path-query": F.col("path").contains("?"), "path-case": F.regexp_replace("path", r"\{[^}]*\}", "").rlike("[A-Z]"),
        "path-parameter": F.size(F.array_except(wanted, F.coalesce("params", F.array().cast("array<string>")))) > 0, "operation-deprecated": yes("deprecated"),
    }
    hits = F.array_compact(F.array(*(F.when(tests[r], F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, _ in LINT)))
    out = o.select("doc_id", "path", "verb", F.explode(hits).alias("h")).select("doc_id", "path", "verb", "h.*")
    ids = c.filter("field = 'operationId'")
    twice = ids.groupBy("doc_id", "value").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "value")
    dup = ids.join(twice, ["doc_id", "value"], "left_semi").select("doc_id", "path", "verb", F.lit("operation-id-unique").alias("rule_id"), F.lit("HIGH").alias("severity"))
    return out.unionByName(dup)


#: Levels of change, the gravest first.
LEVELS = ("breaking", "warning", "refactor", "info", "docs")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, verb, change, level, detail) between the nodes of two versions (each one document)."""
    a, b = _children(old), _children(new)
    oa, ob = operations(old).select("path", "verb").distinct(), operations(new).select("path", "verb").distinct()
    empty = F.lit(None).cast("string")
    removed = oa.join(ob, ["path", "verb"], "left_anti").select("path", "verb", F.lit("operation-removed").alias("change"), F.lit("breaking").alias("level"), empty.alias("detail"))
    added = ob.join(oa, ["path", "verb"], "left_anti").select("path", "verb", F.lit("operation-added").alias("change"), F.lit("info").alias("level"), empty.alias("detail"))
    both = oa.join(ob, ["path", "verb"], "left_semi")
    av, bv = (x.filter("kind = 'scalar'").join(both, ["path", "verb"], "left_semi").select("path", "verb", "field", "value") for x in (a, b))
    j = av.withColumnRenamed("value", "was").join(bv.withColumnRenamed("value", "now"), ["path", "verb", "field"], "full_outer").filter("NOT was <=> now")
    f = F.col("field")
    gone, come = F.col("now").isNull(), F.col("was").isNull()
    kinds = (
        (f.rlike(r"(^|\.)(summary|description|example\w*|externalDocs.*)$"), "documentation", "docs"),
        (f.rlike(r"^operationId$|^tags"), "naming", "refactor"),
        (f.rlike(r"^responses.*\.type$|^parameters.*\.type$|^requestBody.*\.type$"), "type-changed", "breaking"),
        (f.rlike(r"^parameters\[\d+\]\.required$|^requestBody\.required$") & (F.col("now") == "true"), "became-required", "breaking"),
        (f.rlike(r"^parameters\[\d+\]\.required$|^requestBody\.required$"), "became-optional", "info"),
        (f.rlike(r"^parameters\[\d+\]\.name$") & gone, "parameter-removed", "warning"),
        (f.rlike(r"^parameters\[\d+\]\.name$") & come, "parameter-added", "info"),
        (f.rlike(r"\.enum\[\d+\]$") & gone, "enum-value-removed", "breaking"),
        (f.rlike(r"\.enum\[\d+\]$"), "enum-value-added", "warning"),
        (f.rlike(r"^responses") & gone, "response-removed", "breaking"),
        (f.rlike(r"^responses") & come, "response-added", "info"),
        (f.rlike(r"^security"), "security-changed", "warning"),
        (f == "deprecated", "deprecation", "info"),
    )
    change, level = F.lit("changed"), F.lit("warning")
    for test, c, lv in reversed(kinds):
        change, level = F.when(test, c).otherwise(change), F.when(test, lv).otherwise(level)
    changed = j.select("path", "verb", change.alias("change"), level.alias("level"), f.alias("detail"))
    return removed.unionByName(added).unionByName(changed)


def by_root_cause(changes: DataFrame) -> DataFrame:
    """Changes grouped by kind and detail, the gravest level first: one cause often shows in many operations."""
    rank = F.coalesce(*(F.when(F.col("level") == x, F.lit(k)) for k, x in enumerate(LEVELS)))
    return changes.groupBy("change", "level", F.coalesce("detail", F.lit("")).alias("detail")).agg(F.count("*").alias("operations"), F.min(F.struct("path", "verb")).alias("first")).withColumn("rank", rank)


def introduced(base: DataFrame, head: DataFrame) -> DataFrame:
    """Lint findings of head that base does not have."""
    return head.join(base.select("path", "verb", "rule_id").distinct(), ["path", "verb", "rule_id"], "left_anti")
