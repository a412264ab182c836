"""More registered queries: report relations, windowed rules and the graph of modules, each with its twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import evolution, graph, history, report, rules, scoring, symbols, windows
from lodestrata.plans.queries import COMMITS, FILES, FINDINGS, FUNCS, LINES, QUERIES, TOUCHED, _decl_sql, code, delivered_code, files, findings, functions, query, touched
from lodestrata.sources.tables import table


_CHURN = f"{TOUCHED}, p AS (SELECT repo, rel_path, author, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY repo, rel_path ORDER BY n DESC, author) AS k FROM p)"


@query(f"WITH {FINDINGS}, {FILES}, {_CHURN}, o AS (SELECT file_id, author AS owner FROM k JOIN files USING (repo, rel_path) WHERE k = 1) SELECT finding_id, owner FROM f LEFT JOIN o USING (file_id)")
def finding_owners(spark, d):
    return report.finding_owners(findings(spark, d), history.churn(touched(spark, d)), files(spark, d)).select("finding_id", "owner")


@query(
    f"WITH {FINDINGS}, g AS (SELECT repo, rule_id, severity, count(*) AS hits, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS sr FROM f JOIN rules USING (rule_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY sr DESC, hits DESC, rule_id) AS place FROM g) SELECT repo, rule_id, hits, place FROM r WHERE place <= 18"
)
def priority_issues(spark, d):
    f = findings(spark, d).join(table(spark, d, "rules", "rule_id", "severity"), "rule_id").groupBy("repo", "rule_id", "severity").agg(F.count("*").alias("hits")).withColumn("severity_rank", rules.severity_rank())
    return report.priority_issues(f).select("repo", "rule_id", "hits", "place")


@query(f"WITH {FILES} SELECT repo, language_id, CAST(sum(ceil(coalesce(length(content), 0) / 4)) AS BIGINT) AS tokens, count(*) AS files FROM files GROUP BY ALL")
def token_estimate(spark, d):
    return report.token_estimate(files(spark, d), "repo", "language_id")


_DOMAIN = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.DOMAINS.items()) + " ELSE 'other' END"


@query(f"WITH {FINDINGS} SELECT {_DOMAIN} AS domain, count(*) AS n, round(avg(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END), 4) AS high_share FROM f JOIN rules USING (rule_id) GROUP BY 1")
def compliance_domains(spark, d):
    return report.compliance(findings(spark, d).join(table(spark, d, "rules", "rule_id", "category", "severity"), "rule_id"))


@query(f"WITH {LINES}, o AS (" + " UNION ALL ".join(f"SELECT file_id, language_id, line_no, '{k}' AS kind FROM code WHERE NOT comment AND regexp_matches(raw, '{p}')" for k, p in report.OBSERVED.items()) + ") SELECT language_id, kind, count(*) AS n, count(DISTINCT file_id) AS files FROM o GROUP BY ALL")
def observability(spark, d):
    return report.observability(delivered_code(spark, d))


@query(
    f"WITH {COMMITS}, m AS (SELECT max(ts) AS now FROM c), a AS (SELECT repo, epoch(now) - epoch(max(ts)) AS s FROM c, m GROUP BY repo, now) SELECT repo, CASE WHEN s >= 31536000 THEN concat(CAST(floor(s / 31536000) AS BIGINT), 'y ago') WHEN s >= 2592000 THEN concat(CAST(floor(s / 2592000) AS BIGINT), 'mo ago') WHEN s >= 86400 THEN concat(CAST(floor(s / 86400) AS BIGINT), 'd ago') WHEN s >= 3600 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h ago') ELSE concat(CAST(floor(s / 60) AS BIGINT), 'min ago') END AS last_commit FROM a"
)
def last_commit_age(spark, d):
    c = history.commits_once(table(spark, d, "commits"))
    now = c.agg(F.max("ts").alias("now"))  # one row
    a = c.groupBy("repo").agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(now))
    s = (history.micros("now") - history.micros("ts")) / 1_000_000
    return a.select("repo", report.age(s).alias("last_commit"))


@query(f"WITH {FINDINGS} SELECT finding_id, CASE WHEN length(snippet) > 60 THEN concat(left(snippet, 59), '…') ELSE snippet END AS snippet FROM f")
def short_snippets(spark, d):
    return findings(spark, d).select("finding_id", report.shortened("snippet", 60).alias("snippet"))


@query(f"WITH {FILES}, n AS (SELECT repo, language_id, count(*) AS n FROM files WHERE language_id IS NOT NULL GROUP BY ALL) SELECT repo, string_agg(concat(language_id, '=', n), ',' ORDER BY concat(language_id, '=', n)) AS mix FROM n GROUP BY repo")
def language_mix(spark, d):
    return report.language_mix(files(spark, d))


@query(f"WITH {FILES} SELECT repo, CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE '' END AS package, count(*) AS files, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars FROM files GROUP BY 1, 2")
def package_grid(spark, d):
    return report.package_grid(files(spark, d))


@query("WITH x AS (SELECT file_id, repo, symbol, start_line, max(coalesce(documented, false)) AS documented FROM crap_funcs GROUP BY ALL) SELECT repo, count(*) AS functions, count(*) FILTER (documented) AS documented, round(avg(CAST(documented AS INT)), 4) AS share FROM x GROUP BY repo")
def doc_coverage(spark, d):
    f = table(spark, d, "crap_funcs", "file_id", "repo", "symbol", "start_line", "documented").groupBy("file_id", "repo", "symbol", "start_line").agg(F.max(F.coalesce("documented", F.lit(False))).alias("documented"))
    return report.doc_coverage(f, "repo")


@query("SELECT rule_id, CASE category WHEN 'injection' THEN 'HIGH' ELSE severity END AS severity FROM rules WHERE category <> 'code_quality'")
def overlaid_rules(spark, d):
    r = table(spark, d, "rules", "rule_id", "category", "severity")
    wanted = r.select("rule_id", F.when(F.col("category") == "injection", "HIGH").when(F.col("category") == "code_quality", "off").alias("severity")).filter("severity IS NOT NULL")
    return report.overlaid(r, wanted).select("rule_id", "severity")


@query(f"WITH {COMMITS}, x AS (SELECT author, count(*) FILTER (is_merge) AS a, count(*) FILTER (NOT coalesce(is_merge, false)) AS b FROM c GROUP BY author) SELECT author AS name, a AS \"then\", b AS now FROM x WHERE a > 0 AND b > 0 AND a <> b")
def differing_metrics(spark, d):
    c = history.commits_once(table(spark, d, "commits"))
    side = lambda m: c.filter(F.coalesce("is_merge", F.lit(False)) == m).groupBy(F.col("author").alias("name")).agg(F.count("*").alias("value"))
    return report.differing_metrics(side(True), side(False))


@query(f"WITH {FINDINGS} SELECT repo, bool_or(severity = 'HIGH') AS fails, count(*) FILTER (severity IN ('HIGH', 'MEDIUM')) AS n FROM f JOIN rules USING (rule_id) WHERE NOT suppressed GROUP BY repo")
def fail_gate(spark, d):
    f = findings(spark, d).filter("NOT suppressed").join(table(spark, d, "rules", "rule_id", "severity"), "rule_id")
    return f.groupBy("repo").agg(F.max(rules.severity_rank() >= 3).alias("fails"), F.sum((rules.severity_rank() >= 2).cast("long")).alias("n"))


@query(f"WITH {FILES}, {FINDINGS}, h AS (SELECT DISTINCT repo FROM f JOIN rules USING (rule_id) WHERE severity = 'HIGH') SELECT file_id FROM files WHERE repo IN (SELECT repo FROM h)")
def files_of_risky_repos(spark, d):
    h = findings(spark, d).join(table(spark, d, "rules", "rule_id", "severity").filter("severity = 'HIGH'"), "rule_id").select("repo").distinct()
    return files(spark, d).select("file_id", "repo").join(h, "repo", "left_semi").select("file_id")


_LADDER = "CASE " + " ".join(f"WHEN overall >= {need}" + (f" AND weakest >= {least}" if least else "") + f" THEN '{name}'" for name, need, least in reversed(scoring.LEVELS)) + " END"


@query(QUERIES["culture_measures"][1].replace("SELECT m.repo,", "SELECT m.repo AS repo,").join((f"WITH cm AS (", f"), x AS (SELECT repo, floor((security + complexity) / 2) AS overall, least(security, complexity) AS weakest FROM cm) SELECT repo, CAST(overall AS INTEGER) AS overall, {_LADDER} AS level FROM x")))
def level_ladder(spark, d):
    """Repos on the ladder of levels, by the mean of their security and complexity scores, held back by the weaker one."""
    m = QUERIES["culture_measures"][0](spark, d).withColumn("overall", F.floor((F.col("security") + F.col("complexity")) / 2).cast("int"))
    return m.select("repo", "overall", scoring.ladder(F.col("overall"), F.col("security"), F.col("complexity")).alias("level"))


# --- windows over lines -------------------------------------------------------
@query(
    f"WITH {LINES}, s AS (SELECT *, CASE WHEN comment THEN 0 ELSE length(stripped) - length(replace(stripped, '{{', '')) - (length(stripped) - length(replace(stripped, '}}', ''))) END AS step FROM code), w AS (SELECT file_id, coalesce(sum(step) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM s) SELECT file_id, CAST(max(depth) AS INTEGER) AS deepest, count(*) FILTER (depth > 3) AS deep_lines FROM w GROUP BY file_id"
)
def brace_depth(spark, d):
    return windows.brace_depth(code(spark, d)).groupBy("file_id").agg(F.max("depth").alias("deepest"), F.sum((F.col("depth") > 3).cast("long")).alias("deep_lines"))


_EMPTY = (r"^\s*(?:if|for|while|else|try|catch)\b.*\{\s*$", r"^\s*\}")


@query(f"WITH {LINES}, s AS (SELECT *, lead(stripped) OVER (PARTITION BY file_id ORDER BY line_no) AS nx FROM code WHERE NOT comment AND trim(stripped, ' ') <> '') SELECT file_id, line_no FROM s WHERE regexp_matches(stripped, '{_EMPTY[0]}') AND regexp_matches(nx, '{_EMPTY[1]}')")
def empty_branches(spark, d):
    return windows.next_line(code(spark, d), *_EMPTY).select("file_id", "line_no")


_OPENS, _CLOSES = r"\b(?:open|Open|connect|Connect|lock|Lock|acquire)\w*\(", r"\b(?:close|Close|unlock|Unlock|release|defer|with|using|try)\b"


@query(f"WITH {LINES}, s AS (SELECT *, max(CAST(regexp_matches(stripped, '{_CLOSES}') AS INT)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS near FROM code) SELECT file_id, line_no FROM s WHERE NOT comment AND regexp_matches(stripped, '{_OPENS}') AND near = 0")
def unpaired_acquires(spark, d):
    return windows.unpaired(code(spark, d), _OPENS, _CLOSES).select("file_id", "line_no")


_GATE, _INSIDE = r"^\s*(?:import|from|use|#include)\b.*\b(?:log|logging|http|fmt|sync)\b|^\s*\"(?:fmt|log|net/http|sync)\"", r"\b(?:log|logging|fmt|http)\.\w+\("


@query(f"WITH {LINES}, g AS (SELECT DISTINCT file_id FROM code WHERE regexp_matches(raw, '{_GATE}')) SELECT DISTINCT file_id, line_no FROM code WHERE NOT comment AND regexp_matches(stripped, '{_INSIDE}') AND file_id IN (SELECT file_id FROM g)")
def gated_lines(spark, d):
    return windows.gated(delivered_code(spark, d), _GATE, _INSIDE).select("file_id", "line_no").distinct()


# --- changes ------------------------------------------------------------------
_CHANGED = f"{TOUCHED}, {FINDINGS}, {FILES}, ch AS (SELECT rel_path AS path, count(*) AS churn, CAST(sum(added) AS BIGINT) AS added FROM t GROUP BY rel_path), w AS (SELECT rel_path AS path, CAST(sum(CASE severity WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.0 WHEN 'LOW' THEN 0.5 ELSE 0 END) AS DOUBLE) AS weight, count(*) FILTER (severity = 'HIGH') AS security FROM f JOIN rules USING (rule_id) JOIN files USING (file_id) GROUP BY rel_path)"


def _changed(spark, d):
    ch = touched(spark, d).groupBy(F.col("rel_path").alias("path")).agg(F.count("*").alias("churn"), F.sum("added").cast("long").alias("added"))
    f = findings(spark, d).join(table(spark, d, "rules", "rule_id", "severity"), "rule_id").join(files(spark, d).select("file_id", F.col("rel_path").alias("path")), "file_id")
    w = f.groupBy("path").agg(F.sum(rules.severity_weight()).alias("weight"), F.sum((F.col("severity") == "HIGH").cast("long")).alias("security"))
    return ch.join(w, "path", "left").fillna(0, ["weight", "security"]).withColumn("complexity", F.lit(0))


@query(f"WITH {_CHANGED}, s AS (SELECT path, round(coalesce(weight, 0) + 3 * coalesce(security, 0) + least(6, floor(log2(churn + 1))), 2) AS score FROM ch LEFT JOIN w USING (path)) SELECT path, score FROM s ORDER BY score DESC, path LIMIT 5")
def read_first(spark, d):
    return evolution.read_first(_changed(spark, d)).select("path", "score")


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)\.[^./]+$', 1), '(?i)(^test_|_test$|\.spec$|\.test$|Test$|_spec$)', '', 'g')"
_TEST = r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*\.py$|_test\.(go|py|rs)$|\.(spec|test)\.[jt]sx?$|Tests?\.java$"


@query(
    f"WITH {_CHANGED}, s AS (SELECT path, added, regexp_matches(path, '{_TEST}') AS is_test, {_STEM} AS stem, regexp_replace(path, '/?[^/]*$', '') AS folder FROM ch) SELECT path, added FROM s WHERE NOT is_test AND added >= 10 AND stem NOT IN (SELECT stem FROM s WHERE is_test) AND folder NOT IN (SELECT folder FROM s WHERE is_test)"
)
def untested_changes(spark, d):
    return evolution.untested(_changed(spark, d).withColumn("is_test", F.col("path").rlike(_TEST)))


@query(
    f"WITH {LINES}, {FUNCS}, a AS (SELECT file_id, symbol AS name, min(start_line) AS was FROM fn GROUP BY ALL), b AS (SELECT file_id, name, min(line_no) AS now FROM (SELECT file_id, line_no, {_decl_sql(symbols.FUNCTION_PATTERN)} AS name FROM code WHERE NOT comment) WHERE name <> '' GROUP BY ALL), j AS (SELECT CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'deleted' WHEN was <> now THEN 'updated' END AS state FROM a FULL OUTER JOIN b USING (file_id, name)) SELECT 'function' AS kind, state, count(*) AS n FROM j WHERE state IS NOT NULL GROUP BY state"
)
def change_summary(spark, d):
    """Functions as an earlier run saw them against those declared now; the line stands for the digest."""
    then = functions(spark, d).groupBy(F.col("file_id").alias("path"), F.col("symbol").alias("name")).agg(F.min("start_line").alias("digest")).withColumn("kind", F.lit("function"))
    now = symbols.declarations(delivered_code(spark, d)).filter("kind = 'function'").groupBy(F.col("file_id").alias("path"), "name").agg(F.min("line_no").alias("digest")).withColumn("kind", F.lit("function"))
    return evolution.change_summary(then, now)


# --- the graph of modules -----------------------------------------------------
_IMPORTS = QUERIES["import_counts"][1].split("WITH ", 1)[1].split(") SELECT language_id, import_name", 1)[0] + ")"
_MODULES = f"{_IMPORTS}, mo AS (SELECT DISTINCT module_name AS m FROM files WHERE module_name IS NOT NULL), im AS (SELECT DISTINCT module_name AS src, import_name, regexp_extract(import_name, '^([^./:]+)', 1) AS fi, regexp_extract(import_name, '([^./:]+)$', 1) AS la FROM i JOIN files USING (file_id) WHERE import_name <> '' AND module_name IS NOT NULL), e AS (SELECT DISTINCT src, coalesce(a.m, b.m, z.m) AS dst FROM im LEFT JOIN mo a ON a.m = import_name LEFT JOIN mo b ON b.m = fi LEFT JOIN mo z ON z.m = la WHERE coalesce(a.m, b.m, z.m) IS NOT NULL AND coalesce(a.m, b.m, z.m) <> src)"


def _module_edges(spark, d):
    f = files(spark, d).filter("module_name IS NOT NULL").select("file_id", F.col("module_name").alias("module"))
    i = symbols.imports(delivered_code(spark, d)).select("file_id", "import_name").distinct().join(f, "file_id").select("module", "import_name").distinct()
    return graph.edges_once(graph.import_edges(i, f.select("module").distinct()))


@query(f"WITH {_MODULES} SELECT src, dst FROM e")
def module_edges(spark, d):
    return _module_edges(spark, d)


@query(f"WITH {_MODULES}, ends AS (SELECT src AS node, 0 AS ca, 1 AS ce FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ce) AS BIGINT) AS ce, round(sum(ce)::DOUBLE / (sum(ca) + sum(ce)), 4) AS instability FROM ends GROUP BY node")
def module_instability(spark, d):
    return graph.degrees(_module_edges(spark, d))


@query()
def module_hotspots(spark, d):
    return graph.hotspots(_module_edges(spark, d))
