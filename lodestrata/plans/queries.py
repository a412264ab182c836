"""Registered queries of the engine's operators, each with its twin in SQL where SQL can express it.

Every query runs over its whole tables. A query is a pair (function of spark and
folder, SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import entropy, route_key
from lodestrata.operators import catalog, clones, devops, evolution, graph, history, leaks, risk, rules, scoring, symbols, traffic
from lodestrata.operators.rule_tables import LEAKS, QUALITY, SECURITY
from lodestrata.sources.lines import code_lines, distinct_files, file_lines, lines
from lodestrata.sources.tables import spread, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# --- shared inputs -----------------------------------------------------------
def files(spark: SparkSession, d: str) -> DataFrame:
    return distinct_files(table(spark, d, "source_files", "file_id", "repo", "rel_path", "language_id", "is_test", "line_count", "module_name", "content"))


def code(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).filter("language_id IS NOT NULL")
    return code_lines(f, "content", "file_id", "repo", "language_id", "is_test")


def delivered_code(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every delivery of a file: for results that are made distinct, least or greatest by file and line anyway.

    What travels then are results, never texts.
    """
    f = table(spark, d, "source_files", "file_id", "repo", "language_id", "is_test", "content").filter("language_id IS NOT NULL")
    return code_lines(spread(f), "content", "file_id", "repo", "language_id", "is_test")


def findings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings", "finding_id", "rule_id", "repo", "file_id", "line_no", "snippet", "author", "suppressed", "found_at")
    return f.dropDuplicates(["finding_id"])


def functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crap_funcs").select("file_id", "repo", "symbol", "start_line", "end_line", "loc", "ccn", "params", "nesting").distinct()


def touched(spark: SparkSession, d: str) -> DataFrame:
    return history.touches(table(spark, d, "commits", "repo", "sha", "author", "ts", "subject", "is_merge"), table(spark, d, "commit_files"))


FILES = "files AS (SELECT DISTINCT file_id, repo, rel_path, language_id, is_test, line_count, module_name, content FROM source_files)"
# line_count is stale in some redelivered rows, so SQL takes one row a file as the engine does
FILES = "files AS (SELECT file_id, any_value(repo) AS repo, any_value(rel_path) AS rel_path, any_value(language_id) AS language_id, any_value(is_test) AS is_test, any_value(line_count) AS line_count, any_value(module_name) AS module_name, any_value(content) AS content FROM source_files GROUP BY file_id)"
LINES = (
    FILES
    + r""", whole AS (SELECT *, regexp_replace(content, '\r\n?', chr(10), 'g') AS t FROM files WHERE language_id IS NOT NULL AND content <> ''),
split AS (SELECT file_id, repo, language_id, is_test, string_split(CASE WHEN right(t, 1) = chr(10) THEN left(t, -1) ELSE t END, chr(10)) AS l FROM whole),
raw_lines AS (SELECT file_id, repo, language_id, is_test, unnest(l) AS raw, generate_subscripts(l, 1) AS line_no FROM split),
code AS (SELECT *, regexp_replace(raw, '//.*$|#.*$|(")(?:\\.|[^"\\])*("|$)|('')(?:\\.|[^''\\])*(''|$)|(`)[^`]*(`|$)', '\1\2\3\4\5\6', 'g') AS stripped,
regexp_matches(ltrim(raw), '^(//|#|\*|/\*)') AS comment FROM raw_lines)"""
)
FINDINGS = "f AS (SELECT DISTINCT finding_id, rule_id, repo, file_id, line_no, snippet, author, suppressed, found_at FROM findings)"
FUNCS = "fn AS (SELECT DISTINCT file_id, repo, symbol, start_line, end_line, loc, ccn, params, nesting FROM crap_funcs)"
COMMITS = "c AS (SELECT repo, sha, m.ts AS ts, m.author AS author, m.subject AS subject, m.is_merge AS is_merge FROM (SELECT repo, sha, min({'ts': ts, 'author': coalesce(author, ''), 'subject': coalesce(subject, ''), 'is_merge': is_merge}) AS m FROM commits GROUP BY repo, sha))"
TOUCHED = COMMITS + ", t AS (SELECT c.*, cf.rel_path, cf.added, cf.deleted FROM (SELECT repo, sha, rel_path, max(coalesce(added, 0)) AS added, max(coalesce(deleted, 0)) AS deleted FROM commit_files GROUP BY repo, sha, rel_path) cf JOIN c USING (repo, sha) WHERE NOT coalesce(is_merge, false))"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(p: str | None) -> bool:
    return p is None or not any(x in p for x in ("(?!", "(?=", "(?<!", "(?<=", "\\1", "*+", "++"))


# --- lines and rules ---------------------------------------------------------
@query(f"WITH {LINES} SELECT language_id, count(*) AS n_lines, CAST(sum(length(raw)) AS BIGINT) AS chars, count(DISTINCT file_id) AS n_files FROM code GROUP BY language_id")
def line_scan(spark, d):
    per = spread(table(spark, d, "source_files", "file_id", "language_id", "content")).filter("language_id IS NOT NULL AND content <> ''")
    sizes = F.transform(file_lines("content"), lambda x: F.length(x))
    per = per.select("file_id", "language_id", F.size(sizes).alias("n"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("chars")).dropDuplicates(["file_id"])
    return per.groupBy("language_id").agg(F.sum("n").cast("long").alias("n_lines"), F.sum("chars").cast("long").alias("chars"), F.count("*").alias("n_files"))


@query(f"WITH {LINES} SELECT file_id, CAST(sum(length(stripped)) AS BIGINT) AS stripped_chars, CAST(sum(CAST(comment AS INT)) AS BIGINT) AS comment_lines FROM code GROUP BY file_id")
def stripped_text(spark, d):
    return code(spark, d).groupBy("file_id").agg(F.sum(F.length("stripped")).cast("long").alias("stripped_chars"), F.sum(F.col("comment").cast("int")).cast("long").alias("comment_lines"))


def _rule_sql(rule: rules.Rule) -> str:
    text = rule.text
    where = [f"regexp_matches({text}, {_lit(rule.pattern)})", "NOT comment"]
    if rule.languages:
        where.append("language_id IN (" + ", ".join(map(_lit, rule.languages)) + ")")
    if rule.skip_tests:
        where.append("NOT coalesce(is_test, false)")
    where += [f"NOT contains(lower({text}), {_lit(w.lower())})" for w in rule.skip]
    if rule.shape == "both":
        where.append(f"regexp_matches({text}, {_lit(rule.pattern2)})")
    elif rule.shape == "without":
        where.append(f"NOT regexp_matches({text}, {_lit(rule.pattern2)})")
    return f"SELECT file_id, line_no, {_lit(rule.rule_id)} AS rule_id FROM code WHERE " + " AND ".join(where)


def _present(rule: rules.Rule) -> bool:
    return (not rule.languages or bool({"python", "go", "java", "ts", "rust"} & set(rule.languages))) and _re2(rule.pattern) and _re2(rule.pattern2)


_SEC = [r for r in SECURITY if r.shape in ("line", "both", "without") and _present(r)]
_QUAL = [r for r in QUALITY if r.shape in ("line", "both", "without") and _present(r)]
_STATE = [r for r in SECURITY if r.shape in ("guarded", "paired") and _present(r)]


@query(f"WITH {LINES} " + " UNION ALL ".join(map(_rule_sql, _SEC)))
def security_findings(spark, d):
    return rules.line_findings(delivered_code(spark, d), _SEC).select("file_id", "line_no", "rule_id").distinct()


@query(f"WITH {LINES} " + " UNION ALL ".join(map(_rule_sql, _QUAL)))
def quality_findings(spark, d):
    return rules.line_findings(delivered_code(spark, d), _QUAL).select("file_id", "line_no", "rule_id").distinct()


@query()
def all_rule_findings(spark, d):
    """Every rule of both tables, with patterns that the SQL engine's expressions can't hold."""
    c = delivered_code(spark, d)
    every = [*SECURITY, *QUALITY]
    out = rules.line_findings(c, every).select("file_id", "line_no", "rule_id").distinct()
    return out.unionByName(rules.file_findings(c, every).select("file_id", "line_no", "rule_id"))


def _state_sql(rule: rules.Rule) -> str:
    on = "language_id IN (" + ", ".join(map(_lit, rule.languages)) + ")"
    guard = f"bool_or(regexp_matches({rule.text}, {_lit(rule.pattern2)}))"
    having = f"NOT {guard}" if rule.shape == "guarded" else guard
    return f"SELECT file_id, CAST(min(CASE WHEN {on} AND NOT comment AND regexp_matches({rule.text}, {_lit(rule.pattern)}) THEN line_no END) AS INTEGER) AS line_no, {_lit(rule.rule_id)} AS rule_id FROM code GROUP BY file_id HAVING min(CASE WHEN {on} AND NOT comment AND regexp_matches({rule.text}, {_lit(rule.pattern)}) THEN line_no END) IS NOT NULL AND {having}"


@query(f"WITH {LINES} " + " UNION ALL ".join(map(_state_sql, _STATE)))
def file_state_findings(spark, d):
    return rules.file_findings(delivered_code(spark, d), _STATE).select("file_id", "line_no", "rule_id")


def _leak_sql(x) -> str:
    rule_id, _, langs, acquire, release, ratio, margin = x
    on = "language_id IN (" + ", ".join(map(_lit, langs)) + ") AND NOT comment"
    a, r = f"{on} AND regexp_matches(stripped, {_lit(acquire)})", f"{on} AND regexp_matches(stripped, {_lit(release)})"
    return f"SELECT file_id, {_lit(rule_id)} AS rule_id, line_no FROM code WHERE {a} AND file_id IN (SELECT file_id FROM code GROUP BY file_id HAVING count(*) FILTER ({a}) > floor(count(*) FILTER ({r}) * {ratio}) + {margin})"


_LEAKS = [x for x in LEAKS if {"python", "go", "java", "ts", "rust"} & set(x[2])]


@query(f"WITH {LINES} " + " UNION ALL ".join(map(_leak_sql, _LEAKS)))
def leak_findings(spark, d):
    return leaks.leaks(delivered_code(spark, d), _LEAKS).select("file_id", "rule_id", "line_no")


@query(f"WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY file_id, line_no, finding_id) AS rank FROM f) SELECT rule_id, finding_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def rule_cap(spark, d):
    f = findings(spark, d).withColumn("line_no", F.coalesce("line_no", F.lit(2**31 - 1)))
    return rules.capped(f, 5, "file_id", "line_no", "finding_id").select("rule_id", "finding_id", "rank")


@query(
    f"WITH {FINDINGS}, s AS (SELECT DISTINCT file_id, line_no, rule_id FROM f WHERE suppressed AND line_no IS NOT NULL) SELECT f.finding_id, f.rule_id FROM f WHERE NOT suppressed AND NOT EXISTS (SELECT 1 FROM s WHERE s.file_id = f.file_id AND f.line_no BETWEEN s.line_no AND s.line_no + 2 AND (s.rule_id IS NULL OR s.rule_id = f.rule_id))"
)
def unsuppressed_findings(spark, d):
    """Findings outside the spans of suppressed ones of their rule, by the range anti-join of the engine."""
    from lodestrata.operators.suppress import unsuppressed

    f = findings(spark, d)
    spans = f.filter("suppressed AND line_no IS NOT NULL").select("file_id", F.col("line_no").alias("from_line"), (F.col("line_no") + 2).alias("to_line"), F.when(F.col("rule_id").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lower("rule_id"))).alias("names")).distinct()
    return unsuppressed(f.filter("NOT suppressed"), spans).select("finding_id", "rule_id")


@query(f"WITH {LINES} SELECT file_id, line_no FROM code WHERE regexp_matches(raw, '#\\s*noqa\\b|//\\s*nolint\\b|NOSONAR|pylint:\\s*disable(-line)?=|eslint-disable-next-line')")
def directive_lines(spark, d):
    return delivered_code(spark, d).filter(F.col("raw").rlike(r"#\s*noqa\b|//\s*nolint\b|NOSONAR|pylint:\s*disable(-line)?=|eslint-disable-next-line")).select("file_id", "line_no").distinct()


@query()
def suppression_spans(spark, d):
    from lodestrata.operators.suppress import suppressions

    return suppressions(delivered_code(spark, d)).withColumn("names", F.concat_ws(",", "names")).distinct()


_WEIGHTS = " UNION ALL ".join(f"SELECT {_lit(k)} AS category, {v} AS weight" for k, v in scoring.CATEGORY_WEIGHTS.items())
_SCORED = f"WITH {FINDINGS}, w AS ({_WEIGHTS}), n AS (SELECT count(DISTINCT file_id) AS n FROM source_files), a AS (SELECT category, count(*) AS hits, sum(CASE severity WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.0 WHEN 'LOW' THEN 0.5 ELSE 0 END) AS weighted, count(*) FILTER (severity = 'HIGH') AS high FROM f JOIN rules USING (rule_id) WHERE NOT suppressed GROUP BY category), p AS (SELECT w.category, CAST(w.weight AS INTEGER) AS weight, coalesce(hits, 0) AS hits, CAST(coalesce(weighted, 0) AS DOUBLE) AS weighted, CAST(greatest(floor(coalesce(weighted, 0)::DOUBLE / n / (coalesce(weighted, 0)::DOUBLE / n + 2) * w.weight + 0.5), CASE WHEN coalesce(high, 0) > 0 THEN least(high, w.weight) ELSE 0 END) AS INTEGER) AS points FROM w LEFT JOIN a USING (category), n)"


def _category_scores(spark, d):
    f = findings(spark, d).filter("NOT suppressed").join(table(spark, d, "rules", "rule_id", "category", "severity"), "rule_id")
    n = table(spark, d, "source_files", "file_id").agg(F.count_distinct("file_id")).first()[0]
    return scoring.category_scores(f, int(n))


@query(_SCORED + " SELECT category, weight, hits, weighted, points FROM p")
def category_scores(spark, d):
    return _category_scores(spark, d).select("category", "weight", "hits", "weighted", F.col("points").cast("int").alias("points"))


@query(_SCORED + " SELECT CAST(least(1000, greatest(0, sum(points))) AS INTEGER) AS danger, CASE WHEN sum(points) < 200 THEN 'Hardened' WHEN sum(points) < 500 THEN 'Minor exposure' WHEN sum(points) < 800 THEN 'Elevated risk' ELSE 'Critical exposure' END AS band FROM p")
def danger_index(spark, d):
    return scoring.danger_index(_category_scores(spark, d))


@query(f"WITH {FINDINGS} SELECT rule_id, severity, count(*) AS hits, count(DISTINCT file_id) AS files, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS severity_rank FROM f JOIN rules USING (rule_id) GROUP BY rule_id, severity")
def issue_groups(spark, d):
    return rules.issue_groups(findings(spark, d).join(table(spark, d, "rules", "rule_id", "severity"), "rule_id"))


@query(
    f"WITH {FINDINGS}, l AS (SELECT finding_id, regexp_extract(snippet, '[\"'']([A-Za-z0-9+/=_.!-]{{8,64}})[\"'']', 1) AS lit FROM f WHERE snippet IS NOT NULL), ch AS (SELECT finding_id, lit, unnest(string_split(lit, '')) AS ch FROM l WHERE lit <> ''), n AS (SELECT finding_id, ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY finding_id, ch), t AS (SELECT finding_id, sum(n) AS total FROM n GROUP BY finding_id), e AS (SELECT finding_id, -sum(n / total * log2(n / total)) AS e FROM n JOIN t USING (finding_id) GROUP BY finding_id) SELECT finding_id, round(e, 3) AS entropy FROM e WHERE e >= 3.2"
)
def entropy_gate(spark, d):
    lit = F.regexp_extract("snippet", r"[\"']([A-Za-z0-9+/=_.!-]{8,64})[\"']", 1)
    return findings(spark, d).filter("snippet IS NOT NULL").select("finding_id", lit.alias("lit")).filter("lit <> ''").select("finding_id", F.round(entropy("lit"), 3).alias("entropy")).filter("entropy >= 3.2")


# --- history -----------------------------------------------------------------
@query(f"WITH {TOUCHED} SELECT repo, author, count(DISTINCT sha) AS commits, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(added) AS BIGINT) AS added, count(DISTINCT rel_path) AS files FROM t GROUP BY repo, author")
def author_stats(spark, d):
    return history.author_stats(touched(spark, d))


@query(
    f"WITH {TOUCHED}, p AS (SELECT repo, rel_path, author, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY repo, rel_path ORDER BY n DESC, author) AS k FROM p) SELECT repo, rel_path, CAST(sum(n) AS BIGINT) AS changes, count(*) AS authors, coalesce(string_agg(author, ',' ORDER BY k) FILTER (k <= 3), '') AS top_authors FROM k GROUP BY repo, rel_path"
)
def churn_top(spark, d):
    return history.churn(touched(spark, d))


@query(
    f"WITH {TOUCHED}, b AS (SELECT repo, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM t GROUP BY repo) SELECT repo, rel_path, round(sum(1 / (1 + exp(-12 * CASE WHEN hi = lo THEN 1.0 ELSE CAST(epoch_us(ts) - lo AS DOUBLE) / (hi - lo) END + 12))), 4) AS weight FROM t JOIN b USING (repo) GROUP BY repo, rel_path"
)
def churn_weight(spark, d):
    return history.churn_weight(touched(spark, d))


_WEEKLY = f"WITH {TOUCHED}, l AS (SELECT repo, max(ts) AS last_ts FROM t GROUP BY repo), wa AS (SELECT t.repo AS repo, lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CAST(75 - floor(CAST(floor(epoch_us(last_ts) / 1000000) - floor(epoch_us(ts) / 1000000) AS DOUBLE) / 604800) AS INTEGER) AS week, rel_path FROM t JOIN l USING (repo)), wk AS (SELECT repo, ext, week, count(*) AS touches FROM wa WHERE week >= 0 AND ext <> '' GROUP BY repo, ext, week)"


@query(_WEEKLY + " SELECT repo, ext, week, touches FROM wk")
def weekly_histogram(spark, d):
    return history.weekly(touched(spark, d))


@query(
    _WEEKLY
    + ", p AS (SELECT repo, week, CAST(sum(touches) AS BIGINT) AS touches FROM wk GROUP BY repo, week), v AS (SELECT repo, list_sort(list(touches)) AS v FROM p GROUP BY repo HAVING count(*) >= 4), q AS (SELECT repo, v[CAST(floor(len(v) / 4) AS INT) + 1] AS q1, v[CAST(floor(3 * len(v) / 4) AS INT) + 1] AS q3 FROM v) SELECT repo, week, touches FROM p JOIN q USING (repo) WHERE q3 > q1 AND touches > q3 + 3 * (q3 - q1)"
)
def calendar_anomalies(spark, d):
    return history.calendar_anomalies(history.weekly(touched(spark, d)))


@query(
    f"WITH {COMMITS} SELECT repo, count(*) AS commits, count(*) FILTER (coalesce(is_merge, false)) AS merges, count(*) FILTER (NOT coalesce(is_merge, false) AND regexp_matches(subject, '{history.CONVENTIONAL}')) AS conventional, round(coalesce(avg(CAST(regexp_matches(subject, '{history.CONVENTIONAL}') AS INT)) FILTER (NOT coalesce(is_merge, false)), 0.0), 4) AS share FROM c GROUP BY repo"
)
def commit_hygiene(spark, d):
    return history.hygiene(table(spark, d, "commits"))


@query(f"WITH {COMMITS} SELECT repo, lower(regexp_extract(subject, '^([A-Za-z]+)', 1)) AS kind, count(*) AS n FROM c WHERE NOT coalesce(is_merge, false) GROUP BY ALL")
def subject_types(spark, d):
    return history.subject_types(table(spark, d, "commits"))


@query(
    f"WITH {COMMITS}, h AS (SELECT repo, count(*) AS n, count(*) FILTER (coalesce(is_merge, false)) AS m FROM c GROUP BY repo), x AS (SELECT repo, m::DOUBLE / greatest(n, 1) AS s FROM h), w AS (SELECT repo, unnest([{{'w': CASE WHEN s < 0.05 THEN 3 WHEN s < 0.15 THEN 1 ELSE 0 END, 'model': 'trunk'}}, {{'w': CASE WHEN s >= 0.05 AND s < 0.3 THEN 3 ELSE 1 END, 'model': 'feature branches'}}, {{'w': CASE WHEN s >= 0.3 THEN 3 ELSE 0 END, 'model': 'release branches'}}]) AS x FROM x) SELECT repo, max(x).model AS model, round(max(x).w / sum(x.w), 4) AS confidence FROM w GROUP BY repo"
)
def branching_model(spark, d):
    return history.branching_model(history.hygiene(table(spark, d, "commits")))


@query(
    f"WITH {COMMITS}, k AS (SELECT repo, max(ts) - INTERVAL 30 DAY AS cutoff FROM c GROUP BY repo) SELECT repo, cutoff, max({{'ts': c.ts, 'sha': c.sha}}).sha AS sha, max(c.ts) AS ts FROM c JOIN k USING (repo) WHERE c.ts <= cutoff GROUP BY repo, cutoff"
)
def as_of_commit(spark, d):
    c = table(spark, d, "commits")
    cut = history.commits_once(c).groupBy("repo").agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("cutoff"))
    return history.as_of(c, cut)


@query(
    f"WITH {TOUCHED}, o AS (SELECT repo, sha, rel_path, regexp_replace(rel_path, '/?[^/]*$', '') AS folder FROM t), dd AS (SELECT DISTINCT repo, sha, folder AS other FROM o), p AS (SELECT repo, rel_path, other, count(*) AS n FROM o JOIN dd USING (repo, sha) WHERE folder <> other GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY repo, rel_path ORDER BY n DESC, other) AS k FROM p) SELECT repo, rel_path, other, n FROM k WHERE k = 1"
)
def co_change(spark, d):
    return history.co_change(touched(spark, d))


# --- graphs ------------------------------------------------------------------
_EDGES = "e AS (SELECT DISTINCT s.n_name AS src, t.n_name AS dst FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN nation s ON cu.c_nationkey = s.n_nationkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier su ON l.l_suppkey = su.s_suppkey JOIN nation t ON su.s_nationkey = t.n_nationkey WHERE s.n_name <> t.n_name AND l.l_quantity >= 45)"


def _edges(spark, d):
    """A graph of nations: customers' to suppliers', through orders of large quantities."""
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity").filter("l_quantity >= 45").join(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("c_nationkey", "s_nationkey").distinct()
    return pairs.join(n.toDF("c_nationkey", "src"), "c_nationkey").join(n.toDF("s_nationkey", "dst"), "s_nationkey").select("src", "dst")


_DEG = ", ends AS (SELECT src AS node, 0 AS ca, 1 AS ce FROM e UNION ALL SELECT dst, 1, 0 FROM e), deg AS (SELECT node, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ce) AS BIGINT) AS ce, round(sum(ce)::DOUBLE / (sum(ca) + sum(ce)), 4) AS instability FROM ends GROUP BY node)"


@query(f"WITH {_EDGES}{_DEG} SELECT node, ca, ce, instability FROM deg")
def instability(spark, d):
    return graph.degrees(_edges(spark, d))


def _rank_sql(rounds: int = 40) -> str:
    parts = [f"WITH {_EDGES.replace('e AS (', 'e AS MATERIALIZED (')}{_DEG}, nodes AS MATERIALIZED (SELECT node FROM deg), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), o AS MATERIALIZED (SELECT src, count(*) AS o FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT node, 1 / n AS r FROM nodes, n)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(g.g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM o)) / n) AS r FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / o) AS g FROM e JOIN o USING (src) JOIN r{k - 1} ON r{k - 1}.node = e.src GROUP BY dst) g ON g.dst = nodes.node)")
    return ", ".join(parts) + f" SELECT node, round(r, 6) AS rank FROM r{rounds}"


@query(_rank_sql())
def hotspots_pagerank(spark, d):
    return graph.pagerank(_edges(spark, d)).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {LINES}, i AS (SELECT file_id, language_id, CASE language_id WHEN 'python' THEN CASE WHEN regexp_extract(raw, '^\\s*(?:from\\s+([\\w.]+)\\s+import|import\\s+([\\w.]+))', 1) <> '' THEN regexp_extract(raw, '^\\s*(?:from\\s+([\\w.]+)\\s+import|import\\s+([\\w.]+))', 1) ELSE regexp_extract(raw, '^\\s*(?:from\\s+([\\w.]+)\\s+import|import\\s+([\\w.]+))', 2) END WHEN 'go' THEN regexp_extract(raw, '^\\s*(?:import\\s+)?(?:\\w+\\s+)?\"([\\w./-]+)\"\\s*$', 1) WHEN 'java' THEN regexp_extract(raw, '^\\s*import\\s+(?:static\\s+)?([\\w.]+)', 1) WHEN 'ts' THEN regexp_extract(raw, '^\\s*import\\b.*?from\\s+[\"'']([^\"'']+)[\"'']', 1) WHEN 'rust' THEN regexp_extract(raw, '^\\s*use\\s+([\\w:]+)', 1) END AS import_name FROM code WHERE NOT comment) SELECT language_id, import_name, count(*) AS n, count(DISTINCT file_id) AS files FROM i WHERE import_name <> '' GROUP BY ALL")
def import_counts(spark, d):
    return symbols.imports(code(spark, d)).groupBy("language_id", "import_name").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


# --- duplicates --------------------------------------------------------------
@query(
    f"WITH {LINES}, sig AS (SELECT file_id, line_no, trim(raw, ' ') AS t FROM code WHERE length(trim(raw, ' ')) > 1), w AS (SELECT file_id, line_no, row_number() OVER o AS seq, concat_ws(chr(10), t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o, lead(t, 5) OVER o) AS b, lead(t, 5) OVER o IS NOT NULL AS whole FROM sig WINDOW o AS (PARTITION BY file_id ORDER BY line_no)), v AS (SELECT * FROM w WHERE whole AND length(b) >= 110), m AS (SELECT b FROM v GROUP BY b HAVING count(*) > 1), h AS (SELECT file_id, seq, line_no FROM v WHERE b IN (SELECT b FROM m)), i AS (SELECT *, seq - row_number() OVER (PARTITION BY file_id ORDER BY seq) AS island FROM h) SELECT file_id, min(line_no) AS first_line, CAST(max(seq) - min(seq) + 6 AS INTEGER) AS lines FROM i GROUP BY file_id, island HAVING max(seq) - min(seq) + 6 >= 15"
)
def clone_runs(spark, d):
    return clones.duplicated(code(spark, d))


@query(f"WITH {FILES} SELECT sha256(content) AS digest, min(file_id) AS first_key, count(*) AS copies FROM files WHERE content <> '' GROUP BY sha256(content) HAVING count(*) > 1")
def identical_files(spark, d):
    return clones.identical(files(spark, d))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicates(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return t.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


# --- functions at risk -------------------------------------------------------
_COVER = f"{FUNCS}, cov AS (SELECT file_id, line_no, bool_or(coalesce(suppressed, false)) AS hit FROM f WHERE line_no IS NOT NULL GROUP BY file_id, line_no), cf AS (SELECT fn.file_id, fn.repo, symbol, start_line, end_line, loc, ccn, params, nesting, coalesce(avg(CAST(hit AS INT)), 0.0) AS covered FROM fn LEFT JOIN cov ON cov.file_id = fn.file_id AND cov.line_no BETWEEN start_line AND end_line GROUP BY ALL)"


def _covered(spark, d):
    cov = findings(spark, d).filter("line_no IS NOT NULL").select("file_id", "line_no", F.coalesce("suppressed", F.lit(False)).alias("hit"))
    return risk.coverage_of(functions(spark, d), cov)


@query(f"WITH {FINDINGS}, {_COVER} SELECT file_id, symbol, start_line, end_line, ccn, round(covered, 4) AS covered, round(ccn * ccn * power(1 - covered, 3) + ccn, 2) AS crap FROM cf")
def crap_scores(spark, d):
    return _covered(spark, d).select("file_id", "symbol", "start_line", "end_line", "ccn", F.round("covered", 4).alias("covered"), risk.crap_score(F.col("ccn").cast("double"), F.col("covered")).alias("crap"))


@query(
    f"WITH {FINDINGS}, {_COVER}, {TOUCHED}, {FILES}, b AS (SELECT repo, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM t GROUP BY repo), w AS (SELECT repo, rel_path, round(sum(1 / (1 + exp(-12 * CASE WHEN hi = lo THEN 1.0 ELSE CAST(epoch_us(ts) - lo AS DOUBLE) / (hi - lo) END + 12))), 4) AS weight FROM t JOIN b USING (repo) GROUP BY repo, rel_path), j AS (SELECT cf.*, files.rel_path, coalesce(w.weight, CASE WHEN cf.repo IN (SELECT repo FROM w) THEN 0.0 ELSE 1.0 END) AS wt FROM cf JOIN files USING (file_id) LEFT JOIN w ON w.repo = cf.repo AND w.rel_path = files.rel_path) SELECT file_id, symbol, start_line, ccn, round(ccn * ccn * power(1 - covered, 3) + ccn, 2) AS crap, round(ccn * wt, 4) AS risk FROM j"
)
def crap_rank(spark, d):
    fn = _covered(spark, d).join(files(spark, d).select("file_id", "rel_path"), "file_id")
    return risk.rank(fn, history.churn_weight(touched(spark, d)), digits=4)


@query(
    f"WITH {FINDINGS}, {FUNCS}, j AS (SELECT finding_id, max({{'s': start_line, 'n': symbol}}) AS m FROM f JOIN fn ON fn.file_id = f.file_id AND line_no BETWEEN start_line AND end_line GROUP BY finding_id) SELECT finding_id, m.n AS symbol, m.s AS start_line FROM j"
)
def enclosing_function(spark, d):
    return risk.enclosing(findings(spark, d).select("finding_id", "file_id", "line_no"), functions(spark, d)).select("finding_id", "symbol", "start_line")


@query(f"WITH {FUNCS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id, symbol ORDER BY nesting DESC NULLS LAST, start_line) AS k FROM fn) SELECT file_id, symbol, nesting FROM k WHERE k = 1")
def worst_per_symbol(spark, d):
    return risk.worst_per_symbol(functions(spark, d), "nesting").select("file_id", "symbol", "nesting")


@query(f"WITH {FUNCS} " + " UNION ALL ".join(f"SELECT file_id, symbol, start_line, '{r}' AS rule_id, {m} AS value FROM fn WHERE {m} > {n}" for r, m, n in (("shape-params", "params", 3), ("shape-nesting", "nesting", 3), ("shape-cyclomatic", "ccn", 10), ("shape-lines", "loc", 30))))
def shape_issues(spark, d):
    return risk.shape_issues(functions(spark, d), (("shape-params", "params", 3), ("shape-nesting", "nesting", 3), ("shape-cyclomatic", "ccn", 10), ("shape-lines", "loc", 30)))


@query(
    f"WITH {FILES}, p AS (SELECT DISTINCT rel_path AS path FROM commit_files), u AS (SELECT regexp_extract(rel_path, '([^/]*)$', 1) AS base, list_distinct(list(file_id)) AS ids, any_value(rel_path) AS r FROM files GROUP BY base) SELECT path, ids[1] AS file_id FROM p JOIN u ON u.base = regexp_extract(path, '([^/]*)$', 1) WHERE len(ids) = 1"
)
def suffix_attach(spark, d):
    """Coverage-style paths to files by their longest common ending; ties give none. The SQL twin settles base names of one file only."""
    art = table(spark, d, "commit_files", "rel_path").withColumnRenamed("rel_path", "path")
    return risk.attach_by_suffix(art, files(spark, d).select("file_id", "rel_path"))


# --- names -------------------------------------------------------------------
def _suffix_case(names: dict[str, str], col: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({col}, {_lit(s)}) THEN {_lit(names[s])}" for s in sorted(names, key=lambda s: (-len(s), s))) + " END"


_STRUCT = {s: catalog.structure_name(s) for g in catalog.STRUCTURES.values() for s in g.split()}


def _decl_sql(patterns: dict[str, str]) -> str:
    return "CASE language_id " + " ".join(f"WHEN {_lit(k)} THEN regexp_extract(stripped, {_lit(p)}, 1)" for k, p in patterns.items()) + " END"


@query(f"WITH {LINES}, t AS (SELECT file_id, line_no, {_decl_sql(symbols.TYPE_PATTERN)} AS name FROM code WHERE NOT comment), n AS (SELECT *, {_suffix_case(_STRUCT, 'name')} AS structure, {_suffix_case(catalog.PATTERNS, 'name')} AS pattern FROM t WHERE name <> '') SELECT file_id, line_no, name, structure, pattern FROM n WHERE structure IS NOT NULL OR pattern IS NOT NULL")
def named_types(spark, d):
    t = symbols.declarations(delivered_code(spark, d)).filter("kind = 'type'").select("file_id", "line_no", "name").distinct()
    return catalog.named_types(t)


@query(f"WITH {LINES}, t AS (SELECT language_id, {_decl_sql(symbols.TYPE_PATTERN)} AS ty, {_decl_sql(symbols.FUNCTION_PATTERN)} AS fu FROM code WHERE NOT comment) SELECT language_id, count(*) FILTER (ty <> '') AS types, count(*) FILTER (fu <> '') AS functions FROM t GROUP BY language_id")
def declarations(spark, d):
    k = symbols.declarations(code(spark, d))
    return k.groupBy("language_id").agg(F.sum((F.col("kind") == "type").cast("long")).alias("types"), F.sum((F.col("kind") == "function").cast("long")).alias("functions"))


@query()
def named_algorithms(spark, d):
    return catalog.named_algorithms(functions(spark, d).select("file_id", "symbol", "start_line"))


_KW = " UNION ALL ".join(f"SELECT {_lit(k)} AS language_id, unnest({[*v.split()]}) AS word" for k, v in catalog.KEYWORDS.items())


@query(
    f"WITH {LINES}, kw AS ({_KW}), tot AS (SELECT language_id, count(*) AS total FROM kw GROUP BY language_id), w AS (SELECT DISTINCT language_id, unnest(regexp_extract_all(stripped, '[A-Za-z_]\\w*')) AS word FROM code WHERE NOT comment), u AS (SELECT w.language_id, count(*) AS used FROM w JOIN kw ON kw.language_id = w.language_id AND kw.word = w.word GROUP BY w.language_id) SELECT language_id, used, CAST(total AS INTEGER) AS total, round(used::DOUBLE / total, 4) AS share FROM u JOIN tot USING (language_id)"
)
def language_richness(spark, d):
    return catalog.richness(code(spark, d))


@query()
def magic_constants(spark, d):
    return catalog.magic_constants(code(spark, d))


@query(f"WITH {LINES}, w AS (SELECT repo, unnest(regexp_extract_all(raw, '[A-Za-z_]\\w+')) AS name FROM code), o AS (SELECT repo, name FROM w GROUP BY repo, name HAVING count(*) = 1), de AS (SELECT repo, file_id, line_no, {_decl_sql(symbols.FUNCTION_PATTERN)} AS name FROM code WHERE NOT comment) SELECT de.repo, de.name, de.file_id, de.line_no FROM de JOIN o ON o.repo = de.repo AND o.name = de.name")
def unused_symbols(spark, d):
    return symbols.unused_symbols(code(spark, d)).select("repo", "name", "file_id", "line_no")


@query()
def unused_imports(spark, d):
    return symbols.unused_imports(code(spark, d))


@query(
    f"WITH {LINES}, c AS (SELECT file_id, line_no, regexp_replace(raw, '^\\s*(//+|#+|\\*)\\s?', '') AS b FROM code WHERE comment), h AS (SELECT file_id, line_no, line_no - row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS island FROM c WHERE regexp_matches(b, '[;{{}}]\\s*$|^\\s*\\w[\\w.\\[\\]]*\\s*(=|\\+=|:=)\\s*\\S|^\\s*(if|for|while|return|def|func|fn|const|let|var)\\b.*[(:{{=]|^[\\w.]+\\(.*\\)\\s*$')) SELECT file_id, min(line_no) AS line_no, count(*) AS lines FROM h GROUP BY file_id, island HAVING count(*) >= 3"
)
def commented_code(spark, d):
    return symbols.commented_code(code(spark, d))


@query()
def unreachable_code(spark, d):
    return symbols.unreachable(code(spark, d))


@query(f"WITH {FILES}, g AS (SELECT DISTINCT repo, regexp_replace(rel_path, '/?[^/]*$', '') AS folder, file_id FROM files), n AS (SELECT repo, folder, count(*) AS n FROM g GROUP BY ALL) SELECT repo, folder, 'crowded' AS smell, n FROM n WHERE n > 30 UNION ALL SELECT repo, regexp_replace(folder, '/?[^/]*$', '') AS folder, 'scattered', count(*) FROM n WHERE n = 1 GROUP BY ALL HAVING count(*) > 10")
def folder_smells(spark, d):
    return symbols.folder_smells(files(spark, d))


_LAYER_CASE = "CASE " + " ".join(
    f"WHEN len(list_intersect(parts, {words.split()})) > 0" + (f" OR regexp_matches(low, {_lit(symbols.TEST_NAME)}) THEN 'Tests' WHEN regexp_matches(low, {_lit(symbols.API_NAME)}) THEN 'API / Handlers'" if name == "Tests" else f" THEN {_lit(name)}") for name, words in symbols.LAYERS
) + " ELSE 'Other' END"


@query(f"WITH {FILES}, p AS (SELECT lower(rel_path) AS low, string_split(lower(rel_path), '/') AS parts FROM files) SELECT {_LAYER_CASE} AS layer, count(*) AS files FROM p GROUP BY 1")
def layer_bars(spark, d):
    return symbols.layer_bars(files(spark, d)).select("layer", "files")


@query(f"WITH {LINES} SELECT language_id, count(*) AS lines, round(avg(CAST(comment AS INT)), 4) AS share FROM code WHERE trim(raw, ' ') <> '' GROUP BY language_id")
def comment_share(spark, d):
    return symbols.comment_share(code(spark, d))


@query(f"WITH {LINES} SELECT file_id, CAST(sum(len(regexp_extract_all(stripped, '\\b(?:if|elif|for|while|case|catch|except|when)\\b|&&|\\|\\|'))) AS BIGINT) AS points, count(*) AS lines FROM code WHERE NOT comment GROUP BY file_id")
def complexity_points(spark, d):
    return symbols.complexity_points(code(spark, d))


@query()
def loop_depth(spark, d):
    return symbols.loop_depth(code(spark, d))


# --- traffic -----------------------------------------------------------------
@query(
    f"WITH {LINES}, u AS (SELECT file_id, line_no, unnest(regexp_extract_all(raw, '\\b([a-z][a-z0-9+]{{1,11}})://([^\\s\"''`<>\\\\)\\]]+)')) AS u FROM code WHERE NOT comment) SELECT regexp_extract(u, '://(?:[^@/\\s]*@)?([^:/?#\\s]+)', 1) AS host, count(*) AS places, count(DISTINCT file_id) AS files FROM u WHERE regexp_extract(u, '^([a-z0-9+]+)://', 1) IN ({', '.join(map(_lit, traffic.PROTOCOLS))}) GROUP BY host HAVING host <> ''"
)
def outbound_hosts(spark, d):
    return traffic.hosts(traffic.outbound(code(spark, d))).select("host", "places", "files")


@query()
def outbound_connections(spark, d):
    return traffic.connections(traffic.outbound(code(spark, d)))


@query()
def inbound_routes(spark, d):
    return traffic.inbound(code(spark, d))


_OPS = r"ops AS (SELECT DISTINCT doc_id % 2 AS side, regexp_extract(text, '(?m)^(GET|PUT|POST|PATCH|DELETE) (/\S+)', 1) AS verb, lower(regexp_replace(regexp_replace(regexp_extract(text, '(?m)^(GET|PUT|POST|PATCH|DELETE) (/\S+)', 2), '\$?\{[^/{}]*\}|:[A-Za-z_]\w*|<[^/<>]*>', '{}', 'g'), '/+$', '')) AS key FROM documents WHERE regexp_matches(text, '(?m)^(GET|PUT|POST|PATCH|DELETE) (/\S+)'))"


@query(
    f"WITH {_OPS}, s AS (SELECT verb, key FROM ops WHERE side = 0), c AS (SELECT verb, key FROM ops WHERE side = 1) SELECT verb, key, 'covered' AS state FROM s WHERE EXISTS (SELECT 1 FROM c WHERE c.verb = s.verb AND c.key = s.key) UNION ALL SELECT verb, key, 'missing' FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.verb = s.verb AND c.key = s.key) UNION ALL SELECT verb, key, 'extra' FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE c.verb = s.verb AND c.key = s.key)"
)
def route_coverage(spark, d):
    """Operations of API descriptions: those of one half of the documents as the specification, the other as the code. The SQL twin takes the first of each document."""
    t = _operations(spark, d)
    return traffic.spec_coverage(t.filter("side = 0"), t.filter("side = 1"))


def _operations(spark, d):
    """(side, verb, key): all operations that the documents list."""
    p = r"(?m)^(GET|PUT|POST|PATCH|DELETE) (/\S+)"
    t = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").rlike(p)).select((F.col("doc_id") % 2).alias("side"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("op"))
    return t.select("side", F.regexp_extract("op", p, 1).alias("verb"), route_key(F.regexp_extract("op", p, 2)).alias("key"))


@query()
def served_coverage(spark, d):
    """All operations of API descriptions against the routes that source files serve."""
    return traffic.spec_coverage(_operations(spark, d), traffic.inbound(code(spark, d)))


# --- infrastructure ----------------------------------------------------------
_CHECKS = [(m, s, p, g) for m, s, p, g in devops.CONTAINER if _re2(p)]


@query(
    f"WITH {FILES}, a AS (SELECT * FROM files WHERE language_id IS NULL AND content <> '' AND regexp_matches(rel_path, '(?i)(^|/)([\\w.-]*dockerfile[\\w.-]*|[\\w-]+\\.dockerfile)$')) "
    + " UNION ALL ".join(f"SELECT file_id, {_lit(m)} AS metric, CASE WHEN regexp_matches(content, {_lit(p)}) = {str(g).lower()} THEN 'pass' ELSE {_lit('fail' if s in ('critical', 'high') else 'warn')} END AS status FROM a" for m, s, p, g in _CHECKS)
)
def container_checks(spark, d):
    c = devops.checks(files(spark, d)).filter("artefact = 'container'")
    return c.filter(F.col("metric").isin([x[0] for x in _CHECKS])).select("file_id", "metric", "status")


@query()
def devops_health(spark, d):
    return scoring.check_health(devops.checks(files(spark, d)), "artefact", "metric")


@query()
def dotenv_credentials(spark, d):
    return devops.dotenv_credentials(files(spark, d))


# --- then and now ------------------------------------------------------------
@query(
    f"WITH {FINDINGS}, m AS (SELECT quantile_disc(epoch_us(found_at), 0.5) AS m FROM f), a AS (SELECT rule_id, count(*) AS n FROM f, m WHERE rule_id IS NOT NULL AND epoch_us(found_at) <= m GROUP BY rule_id), b AS (SELECT rule_id, count(*) AS n FROM f, m WHERE rule_id IS NOT NULL AND epoch_us(found_at) > m GROUP BY rule_id) SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.n, 0) AS \"then\", coalesce(b.n, 0) AS now, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL OUTER JOIN b ON a.rule_id = b.rule_id"
)
def then_now_compare(spark, d):
    a, b = _halves(spark, d)
    c = evolution.compare(a.groupBy("rule_id").agg(F.count("*").alias("n")), b.groupBy("rule_id").agg(F.count("*").alias("n")), "rule_id", "n")
    return c.fillna(0, ["then", "now"]).withColumn("delta", F.col("now") - F.col("then"))


def _halves(spark, d):
    f = findings(spark, d).filter("rule_id IS NOT NULL")
    m = findings(spark, d).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(found_at AS timestamp)))").alias("m"))
    f = f.crossJoin(F.broadcast(m))  # one row
    return f.filter("unix_micros(cast(found_at AS timestamp)) <= m"), f.filter("unix_micros(cast(found_at AS timestamp)) > m")


@query(
    f"WITH {FINDINGS}, m AS (SELECT quantile_disc(epoch_us(found_at), 0.5) AS m FROM f), a AS (SELECT repo AS item_key, count(*) AS n FROM f, m WHERE rule_id IS NOT NULL AND epoch_us(found_at) <= m GROUP BY repo), b AS (SELECT repo AS item_key, count(*) AS n FROM f, m WHERE rule_id IS NOT NULL AND epoch_us(found_at) > m GROUP BY repo) SELECT b.item_key, CAST(0 AS BIGINT) AS \"then\", b.n AS now, 'new' AS state FROM b WHERE b.item_key NOT IN (SELECT item_key FROM a) UNION ALL SELECT a.item_key, a.n, 0, 'resolved' FROM a WHERE a.item_key NOT IN (SELECT item_key FROM b) UNION ALL SELECT a.item_key, a.n, b.n, 'grown' FROM a JOIN b USING (item_key) WHERE b.n - a.n >= greatest(3, floor(a.n / 10))"
)
def diff_items(spark, d):
    a, b = (x.groupBy(F.col("repo").alias("item_key")).agg(F.count("*").alias("size")) for x in _halves(spark, d))
    return evolution.diff_items(a, b).fillna(0, ["then", "now"])


@query(f"WITH {COMMITS}, q AS (SELECT repo, strftime(ts, '%Y-%m') AS ref, count(*) AS value FROM c GROUP BY ALL), l AS (SELECT *, lag(value) OVER (PARTITION BY repo ORDER BY ref) AS before FROM q) SELECT repo, ref, value, value - before AS delta FROM l WHERE before IS NOT NULL")
def timeline(spark, d):
    s = history.commits_once(table(spark, d, "commits")).groupBy("repo", F.date_format("ts", "yyyy-MM").alias("ref")).agg(F.count("*").alias("value"), F.min("ts").alias("ts"))
    return evolution.timeline(s, "repo").select("repo", "ref", "value", "delta")


# --- relations, sets and windows --------------------------------------------
@query(f"WITH {FINDINGS} SELECT repo, severity, count(*) AS n, grouping(repo) + grouping(severity) AS level FROM f JOIN rules USING (rule_id) GROUP BY ROLLUP (repo, severity)")
def rollup_findings(spark, d):
    f = findings(spark, d).join(table(spark, d, "rules", "rule_id", "severity"), "rule_id")
    return f.rollup("repo", "severity").agg(F.count("*").alias("n"), (F.grouping("repo") + F.grouping("severity")).cast("long").alias("level"))


@query(f"WITH {FINDINGS} SELECT category, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM f JOIN rules USING (rule_id) GROUP BY category")
def severity_pivot(spark, d):
    f = findings(spark, d).join(table(spark, d, "rules", "rule_id", "category", "severity"), "rule_id")
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return f.groupBy("category").agg(n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"))


@query(f"WITH {FILES} SELECT file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM findings WHERE file_id IS NOT NULL)")
def files_without_findings(spark, d):
    return files(spark, d).select("file_id").join(table(spark, d, "findings", "file_id").distinct(), "file_id", "left_anti")


@query("SELECT author FROM commits WHERE author IS NOT NULL INTERSECT SELECT author FROM findings WHERE author IS NOT NULL")
def authors_in_both(spark, d):
    return table(spark, d, "commits", "author").filter("author IS NOT NULL").intersect(table(spark, d, "findings", "author").filter("author IS NOT NULL"))


@query("SELECT repo FROM source_files EXCEPT SELECT repo FROM commits")
def repos_without_history(spark, d):
    return table(spark, d, "source_files", "repo").subtract(table(spark, d, "commits", "repo"))


@query(f"WITH {FILES} SELECT module_name, count(*) AS files, count(*) FILTER (is_test) AS tests, CAST(sum(length(content)) AS BIGINT) AS chars FROM files GROUP BY module_name")
def module_inventory(spark, d):
    return files(spark, d).groupBy("module_name").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.col("is_test"), F.lit(False)).cast("long")).alias("tests"), F.sum(F.length("content")).cast("long").alias("chars"))


@query(
    "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session"
)
def event_sessions(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    return e.withColumn("n", gap).withColumn("session", F.sum("n").over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("count_order"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(CASE WHEN n_chars = length(text) THEN 1 ELSE 0 END) AS BIGINT) AS right_size FROM documents GROUP BY lang, source")
def document_profile(spark, d):
    t = table(spark, d, "documents", "lang", "source", "n_chars", "text")
    return t.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_chars") == F.length("text"), 1).otherwise(0)).cast("long").alias("right_size"))


@query(
    f"WITH {FINDINGS} SELECT finding_id, concat('{{\"ruleId\":\"', rule_id, '\",\"level\":\"', CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END, '\"}}') AS result FROM f JOIN rules USING (rule_id)"
)
def sarif_rows(spark, d):
    from lodestrata.operators.sinks import LEVEL, _mapped

    f = findings(spark, d).join(table(spark, d, "rules", "rule_id", "severity"), "rule_id")
    return f.select("finding_id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), _mapped(LEVEL, "severity").alias("level"))).alias("result"))


# --- shape of the code base --------------------------------------------------
@query()
def architecture_patterns(spark, d):
    from lodestrata.operators.architecture import pattern_scores

    types = symbols.declarations(code(spark, d)).filter("kind = 'type'").join(files(spark, d).select("file_id", "repo"), "file_id")
    return pattern_scores(types, "repo")


@query()
def technologies(spark, d):
    from lodestrata.operators.architecture import technologies as found

    return found(symbols.imports(code(spark, d)))


@query()
def shared_state(spark, d):
    from lodestrata.operators.architecture import topology

    return topology(code(spark, d))


_CULTURE = f"WITH {FUNCS}, {FINDINGS}, {FILES}, m AS (SELECT fn.repo, count(*) FILTER (loc > 200) AS god, max(loc) AS longest, count(*) FILTER (nesting >= 4) AS cubes, count(*) FILTER (nesting = 3) AS squares FROM fn GROUP BY fn.repo), s AS (SELECT f.repo, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium FROM f JOIN rules USING (rule_id) WHERE NOT suppressed GROUP BY f.repo)"


@query(_CULTURE + " SELECT m.repo, god, longest, cubes, squares, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, CAST(floor(5 + 95 * exp(-(7 * coalesce(high, 0) + 2 * coalesce(medium, 0)) / 40.0) + 0.5) AS INTEGER) AS security, CASE WHEN cubes = 0 AND squares = 0 THEN 80 ELSE CAST(floor(5 + 95 * exp(-(7 * cubes + 2 * squares) / 40.0) + 0.5) AS INTEGER) END AS complexity FROM m LEFT JOIN s ON m.repo = s.repo")
def culture_measures(spark, d):
    from lodestrata.operators import culture

    n = lambda c: F.sum(c.cast("long"))
    fn = functions(spark, d)
    m = fn.groupBy("repo").agg(n(F.coalesce(F.col("loc") > 200, F.lit(False))).alias("god"), F.max("loc").alias("longest"), n(F.coalesce(F.col("nesting") >= 4, F.lit(False))).alias("cubes"), n(F.coalesce(F.col("nesting") == 3, F.lit(False))).alias("squares"))
    s = findings(spark, d).filter("NOT suppressed").join(table(spark, d, "rules", "rule_id", "severity"), "rule_id").groupBy("repo").agg(n(F.col("severity") == "HIGH").alias("high"), n(F.col("severity") == "MEDIUM").alias("medium"))
    j = m.join(s, "repo", "left").fillna(0, ["high", "medium"])
    return j.withColumn("security", culture.security(F.col("high"), F.col("medium"))).withColumn("complexity", culture.complexity(F.col("cubes"), F.col("squares")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
