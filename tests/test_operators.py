"""Operators on small fixtures: nulls, empty tables, ties, repeated rows and hand-made cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import catalog, clones, cohesion, devops, evolution, graph, history, leaks, openapi, risk, rules, scoring, sinks, suppress, symbols, traffic
from lodestrata.operators.rule_tables import QUALITY, SECURITY
from lodestrata.sources import coverage, lines as L, manifests, yaml_nodes

FILES = "file_id long, repo string, rel_path string, language_id string, is_test boolean, content string"


def code(spark, *texts, language="python", is_test=False):
    rows = [(k, "r", f"src/f{k}.py", language, is_test, t) for k, t in enumerate(texts)]
    return L.code_lines(spark.createDataFrame(rows, FILES), "content", "file_id", "repo", "language_id", "is_test")


def fired(spark, language, *texts, table=SECURITY):
    c = code(spark, *texts, language=language)
    out = rules.line_findings(c, table).select("file_id", "rule_id").union(rules.file_findings(c, [r for r in table if r.shape in ("guarded", "paired")] or SECURITY).select("file_id", "rule_id"))
    return {(r["file_id"], r["rule_id"]) for r in out.collect()}


@pytest.mark.parametrize(
    "rule, language, fire, safe",
    [
        ("python.eval_exec", "python", "x = eval(y)", "x = literal_eval(y)"),
        ("python.unsafe_yaml", "python", "yaml.load(f)", "yaml.load(f, Loader=SafeLoader)"),
        ("python.shell_injection", "python", "subprocess.run(c, shell=True)", "subprocess.run(c)"),
        ("python.weak_hash_new", "python", 'hashlib.new("md5")', 'hashlib.new("sha256")'),
        ("python.assert_used", "python", "assert x", "# assert x"),
        ("go.insecure_tls", "go", "InsecureSkipVerify: true,", "InsecureSkipVerify: false,"),
        ("go.cookie_no_httponly", "go", "c := http.Cookie{Name: n}", "c := http.Cookie{Name: n, HttpOnly: true}"),
        ("go.toctou", "go", "os.Stat(p)\nos.Remove(p)", "os.Stat(p)"),
        ("java.insecure_deserialization", "java", "new ObjectInputStream(in);", "new DataInputStream(in);"),
        ("java.weak_crypto", "java", 'MessageDigest.getInstance("MD5");', 'MessageDigest.getInstance("SHA-256");'),
        ("javascript.eval", "ts", "eval(code)", "medieval(code)"),
        ("javascript.no_helmet", "ts", "const a = express()", "const a = express()\na.use(helmet())"),
        ("rust.unsafe_block", "rust", "unsafe { f() }", "// unsafe { f() }"),
        ("universal.redos", "python", "re.compile(r'(a+)+b')", "re.compile(r'a+b')"),
    ],
)
def test_security_rules(spark, rule, language, fire, safe):
    got = fired(spark, language, fire, safe)
    assert (0, rule) in got and (1, rule) not in got


@pytest.mark.parametrize(
    "rule, language, fire, safe",
    [
        ("py-bare-except", "python", "except:", "except ValueError:"),
        ("py-mutable-default", "python", "def f(a=[]):", "def f(a=None):"),
        ("py-self-assign", "python", "x = x", "x = x + 1"),
        ("py-dup-operand", "python", "if a == a:", "if a == b:"),
        ("dup-subexpr", "go", "if a.b == a.b {", "if a.b == a.c {"),
        ("strings-compare", "go", "strings.Compare(a, b)", "a == b"),
        ("marker-conflict", "java", "<<<<<<< HEAD", "a << b"),
        ("js-var", "ts", "var a = 1", "let a = 1"),
    ],
)
def test_quality_rules(spark, rule, language, fire, safe):
    got = {(r["file_id"], r["rule_id"]) for r in rules.line_findings(code(spark, fire, safe, language=language), QUALITY).collect()}
    assert (0, rule) in got and (1, rule) not in got


def test_rule_ids_are_unique_and_present():
    for table in (SECURITY, QUALITY):
        assert len({r.rule_id for r in table}) == len(table)


def test_lines_edges(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "a\r\nb"), (3, ""), (4, None), (5, "\n")], "file_id long, content string")
    got = {(r["file_id"], r["line_no"], r["raw"]) for r in L.lines(df, "content", "file_id").collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (5, 1, "")}


def test_stripping(spark):
    rows = [('x = "a # b"  # c', 'x = ""  '), ("f('//')  // d", "f('')  "), ("`x`y", "``y"), ('"open', '"'), ("", "")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "raw string").select(T.stripped("raw").alias("s"))
    assert [r["s"] for r in df.collect()] == [b for _, b in rows]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.name_parts(F.lit("parseHTTPResponse_fast")).alias("n"), T.route_key(F.lit("/A/{id}/:x/<int:y>/")).alias("r"), F.round(T.entropy(F.lit("aabb")), 3).alias("e"), T.entropy(F.lit("")).alias("z"), T.ancestors(F.lit("a/b/c.py")).alias("a"), T.masked_url(F.lit("amqp://u:p@h/x")).alias("m"), T.semver(F.lit("v1.2")).alias("v")
    ).first()
    assert row["n"] == ["parse", "http", "response", "fast"] and row["r"] == "/a/{}/{}/{}" and row["e"] == 1.0 and row["z"] == 0.0
    assert row["a"] == ["a", "a/b"] and row["m"] == "amqp://u:***@h/x" and tuple(row["v"]) == (1, 2, 0)


def test_suppression(spark):
    c = code(spark, "x = eval(y)  # noqa\nz = eval(y)\nw = eval(y)  # noqa: other\nv = eval(y)  # noqa: eval_exec")
    f = rules.line_findings(c, [r for r in SECURITY if r.rule_id == "python.eval_exec"]).select("file_id", "line_no", "rule_id")
    left = suppress.unsuppressed(f, suppress.suppressions(c))
    assert sorted(r["line_no"] for r in left.collect()) == [2, 3]


def test_cap_and_gate(spark):
    f = spark.createDataFrame([("a", k, "HIGH" if k == 3 else "LOW") for k in range(5)] + [("b", 1, "LOW")], "rule_id string, line_no int, severity string")
    assert rules.capped(f, 2, "line_no").count() == 3
    assert rules.gate(f, "HIGH") and not rules.gate(f.filter("line_no < 3"), "MEDIUM")


def test_scores(spark):
    f = spark.createDataFrame([("cryptography", "HIGH")] * 3 + [("injection", "LOW")], "category string, severity string")
    s = {r["category"]: r for r in scoring.category_scores(f, 10).collect()}
    d = 6 / 10
    assert s["cryptography"]["points"] == max(int(d / (d + 2) * 110 + 0.5), 3) and s["authentication"]["points"] == 0 and len(s) == 14
    empty = scoring.danger_index(scoring.category_scores(f.limit(0), 10)).first()
    assert empty["danger"] == 0 and empty["band"] == "Hardened"


def test_history_repeats_and_nulls(spark):
    t = datetime(2024, 1, 1)
    c = spark.createDataFrame([("r", "1", None, t, "feat: a", False, None), ("r", "1", None, t, "feat: a", False, t), ("r", "2", "x", datetime(2024, 6, 1), None, None, None)], "repo string, sha string, author string, ts timestamp, subject string, is_merge boolean, ingested_at timestamp")
    cf = spark.createDataFrame([("r", "1", "a/b.py", 3, 1), ("r", "1", "a/b.py", 3, 1), ("r", "2", "a/b.py", None, None)], "repo string, sha string, rel_path string, added int, deleted int")
    got = history.touches(c, cf)
    a = {r["author"]: r for r in history.author_stats(got).collect()}
    assert a[""]["commits"] == 1 and a[""]["added"] == 3 and a["x"]["added"] == 0
    w = history.churn_weight(got).first()["weight"]
    assert w == pytest.approx(0.5 + 1 / (1 + 2.718281828**12), abs=1e-4)
    h = history.hygiene(c).first()
    assert (h["commits"], h["conventional"], h["share"]) == (2, 1, 0.5)
    assert history.churn(got).first()["top_authors"] == ",x"


def test_pagerank_both_ways(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e"), ("a", "b"), ("x", "x"), (None, "a")], "src string, dst string")
    near = {r["node"]: r["rank"] for r in graph.pagerank(e, rounds=6).collect()}
    far = {r["node"]: r["rank"] for r in graph.pagerank(e, rounds=6, max_local_edges=0).collect()}
    assert near.keys() == far.keys() == set("abcde") and all(abs(near[k] - far[k]) < 1e-9 for k in near) and abs(sum(near.values()) - 1) < 1e-9
    assert graph.pagerank(e.limit(0)).count() == 0
    d = {r["node"]: r for r in graph.degrees(e).collect()}
    assert (d["a"]["ca"], d["a"]["ce"], d["d"]["instability"]) == (2, 2, 1.0)


def test_import_edges(spark):
    i = spark.createDataFrame([("m1", "pkg.sub"), ("m1", "core.x"), ("m2", "a/b/util"), ("m2", "none")], "module string, import_name string")
    m = spark.createDataFrame([("pkg.sub",), ("core",), ("util",)], "module string")
    assert {tuple(r) for r in graph.import_edges(i, m).collect()} == {("m1", "pkg.sub"), ("m1", "core"), ("m2", "util")}


def test_clones(spark):
    body = "\n".join(f"value_{k} = compute_something_long({k})" for k in range(20))
    c = code(spark, "start = 1\n" + body, body + "\nother = 2", "unrelated = 1")
    got = {(r["file_id"], r["lines"]) for r in clones.duplicated(c).collect()}
    assert got == {(0, 20), (1, 20)}


def test_cohesion(spark):
    m = lambda n, f, p, x: {"name": n, "field_refs": f, "param_types": p, "external_refs": x}
    rows = [("T", ["a", "b", "c"], [m("f", ["a"], ["X"], ["Z"]), m("g", ["a", "b"], ["X", "Y"], []), m("h", ["c"], [], ["T", "Z"]), m("k", [], [], [])]), ("E", [], [])]
    got = {r["type_name"]: r for r in cohesion.measures(spark.createDataFrame(rows, cohesion.MEMBERS)).collect()}
    assert (got["T"]["cbo"], got["T"]["lcom"], got["T"]["lcom4"]) == (1, 4, 3)
    assert got["T"]["cam"] == pytest.approx(3 / 8) and got["E"]["lcom4"] == 0


def test_risk(spark):
    fn = spark.createDataFrame([(1, "f", 1, 4, 5), (1, "g", 6, 9, 2)], "file_id long, symbol string, start_line int, end_line int, ccn int")
    cov = spark.createDataFrame([(1, 2, True), (1, 3, False), (1, 3, True), (2, 7, True)], "file_id long, line_no int, hit boolean")
    got = {r["symbol"]: r["covered"] for r in risk.coverage_of(fn, cov).collect()}
    assert got == {"f": 1.0, "g": 0.0}
    nested = spark.createDataFrame([(1, "outer", 1, 9), (1, "inner", 3, 5)], "file_id long, symbol string, start_line int, end_line int")
    hit = spark.createDataFrame([(7, 1, 4), (8, 1, 8), (9, 1, None)], "id long, file_id long, line_no int")
    assert {(r["id"], r["symbol"]) for r in risk.enclosing(hit, nested).collect()} == {(7, "inner"), (8, "outer")}


def test_attach_by_suffix(spark):
    art = spark.createDataFrame([("x/src/a.py",), ("b.py",), ("z/none.py",)], "path string")
    files = spark.createDataFrame([(1, "src/a.py"), (2, "lib/a.py"), (3, "p/b.py"), (4, "q/b.py")], "file_id long, rel_path string")
    assert {tuple(r) for r in risk.attach_by_suffix(art, files).collect()} == {("x/src/a.py", 1)}


def test_names(spark):
    d = spark.createDataFrame([("OrderPriorityQueue",), ("UserBuilder",), ("RingBuffer",), ("Plain",)], "name string")
    got = {r["name"]: (r["structure"], r["pattern"]) for r in catalog.named_types(d).collect()}
    assert got == {"OrderPriorityQueue": ("Priority Queue", None), "UserBuilder": (None, "Builder"), "RingBuffer": ("Circular Buffer", None)}
    f = spark.createDataFrame([("fastFibonacciSearch",), ("quick_sort",), ("sortQuickly",), (None,)], "symbol string")
    assert {r["symbol"]: r["algorithm"] for r in catalog.named_algorithms(f).collect()} == {"fastFibonacciSearch": "Fibonacci Search", "quick_sort": "Quicksort"}


def test_magic_and_loops(spark):
    c = code(spark, "h = 0x811C9DC5\nk = 2166136261\nm = 4129\n", "for a in b:\n    for c in d:\n        pass\n    while x:\n        for y in z:\n            pass\n")
    assert {(r["line_no"], r["constant"][:5]) for r in catalog.magic_constants(c).collect()} == {(1, "FNV-1"), (2, "FNV-1")}
    assert {(r["file_id"], r["loops"], r["depth"]) for r in symbols.loop_depth(c).collect()} == {(1, 4, 3)}


def test_symbols(spark):
    c = code(spark, "import os\nimport sys\nfrom a import b as c\nprint(sys)\ndef used():\n    return 1\n    x = 2\nused()\ndef never():\n    pass\n")
    assert {r["name"] for r in symbols.unused_imports(c).collect()} == {"os", "c"}
    assert {r["name"] for r in symbols.unused_symbols(c).collect()} == {"never"}
    assert [r["text"] for r in symbols.unreachable(c).collect()] == ["x = 2"]
    dead = code(spark, "# x = 1\n# foo(x)\n# if a:\nb = 1\n# words about it\n")
    assert [(r["line_no"], r["lines"]) for r in symbols.commented_code(dead).collect()] == [(1, 3)]


def test_leaks(spark):
    c = code(spark, "f = open(a)\ng = open(b)\ng.close()", "with open(a) as f:\n    pass", language="python")
    assert {(r["file_id"], r["line_no"]) for r in leaks.leaks(c).collect()} == {(0, 1), (0, 2)}


def test_traffic(spark):
    c = code(spark, 'u = "postgres://a:pw@db:5432/x"\nv = "https://h.example/y"', '@app.get("/users/{id}")\ndef f(): pass')
    out = {(r["protocol"], r["host"], r["port"]) for r in traffic.outbound(c).collect()}
    assert out == {("PostgreSQL", "db", "5432"), ("REST", "h.example", "")}
    assert [(r["verb"], r["key"]) for r in traffic.inbound(c).collect()] == [("GET", "/users/{}")]
    spec = spark.createDataFrame([("GET", "/a"), ("PUT", "/b"), ("GET", "/c")], "verb string, key string")
    have = spark.createDataFrame([("GET", "/a"), ("ANY", "/b"), ("POST", "/d")], "verb string, key string")
    assert {tuple(r) for r in traffic.spec_coverage(spec, have).collect()} == {("GET", "/a", "covered"), ("PUT", "/b", "covered"), ("GET", "/c", "missing"), ("POST", "/d", "extra")}


SPEC = """openapi: 3.0.0
paths:
  /users/{id}:
    get:
      operationId: getUser
      summary: one user
      responses: {'200': {description: ok}}
    delete:
      operationId: getUser
      responses: {'404': {description: none}}
"""


def test_openapi(spark):
    n = yaml_nodes.read(spark.createDataFrame([(1, SPEC), (2, None), (3, "a: [b")], "doc_id long, content string"))
    assert {(r["verb"], r["key"], r["line_no"]) for r in openapi.operations(n).collect()} == {("GET", "/users/{}", 5), ("DELETE", "/users/{}", 9)}
    got = {(r["verb"], r["rule_id"]) for r in openapi.lint(n).collect()}
    assert ("DELETE", "operation-success") in got and ("GET", "operation-success") not in got and ("GET", "path-parameter") in got and ("GET", "operation-id-unique") in got
    new = yaml_nodes.read(spark.createDataFrame([(1, SPEC.replace("    delete:", "    put:").replace("one user", "a user"))], "doc_id long, content string"))
    d = {(r["change"], r["level"]) for r in openapi.diff(n.filter("doc_id = 1"), new).collect()}
    assert ("operation-removed", "breaking") in d and ("operation-added", "info") in d and ("documentation", "docs") in d
    assert openapi.by_root_cause(openapi.diff(n.filter("doc_id = 1"), new)).count() >= 3


def test_devops(spark):
    rows = [(1, "r", "a/Dockerfile", None, False, "FROM x:latest\nENV API_KEY=abcd1234\nCMD run\n"), (2, "r", ".env", None, False, "PASSWORD=hunter22\nTOKEN=${X}\n"), (3, "r", "k/d.yaml", None, False, "kind: Deployment\nspec:\n  hostNetwork: true\n")]
    f = spark.createDataFrame(rows, FILES)
    got = {(r["file_id"], r["metric"], r["status"]) for r in devops.checks(f).collect()}
    assert (1, "no latest tag", "warn") in got and (1, "no secrets in ENV", "fail") in got and (3, "no host network", "fail") in got
    assert [(r["line_no"], r["name"]) for r in devops.dotenv_credentials(f).collect()] == [(1, "PASSWORD")]
    q = spark.createDataFrame([("250m",), ("64Mi",), ("2",)], "q string").select(devops.quantity(F.col("q")).alias("n"))
    assert [r["n"] for r in q.collect()] == [0.25, 67108864.0, 2.0]
    o = spark.createDataFrame([("Service", None, "s", '{"type":"LoadBalancer"}'), ("Pod", "a", "p", "{}"), ("NetworkPolicy", "b", "n", "{}"), ("Pod", "b", "q", "{}")], "kind string, namespace string, name string, spec string")
    assert {(r["finding"], r["ns"]) for r in devops.cluster_findings(o).collect()} == {("unrestricted load balancer", "default"), ("no network policy", "a")}


def test_evolution(spark):
    a = spark.createDataFrame([("x", 10), ("y", 50), ("z", 1)], "item_key string, size long")
    b = spark.createDataFrame([("x", 13), ("y", 54), ("n", 2)], "item_key string, size long")
    assert {(r["item_key"], r["state"]) for r in evolution.diff_items(a, b).collect()} == {("x", "grown"), ("z", "resolved"), ("n", "new")}
    ch = spark.createDataFrame([("a/x.py", 20, False), ("b/y.py", 20, False), ("t/test_x.py", 5, True), ("c/z.py", 3, False)], "path string, added int, is_test boolean")
    assert [r["path"] for r in evolution.untested(ch).collect()] == ["b/y.py"]
    sql = spark.createDataFrame([("m", 1, "DROP TABLE x"), ("m", 2, "DELETE FROM x WHERE a = 1"), ("m", 3, "DELETE FROM x")], "path string, line_no int, raw string")
    assert sorted(r["line_no"] for r in evolution.risky_migrations(sql).collect()) == [1, 3]
    h = spark.createDataFrame([("p", 5, 2, 9), ("p", 9, 0, 9)], "path string, new_start int, new_count int, old_start int")
    assert [(r["line_no"], r["old_line"]) for r in evolution.added_lines(h).collect()] == [(5, 9), (6, 10)]
    rf = spark.createDataFrame([("a", 1.0, 1, 0, 3), ("b", 0.0, 0, 0, 0)], "path string, weight double, security int, complexity int, churn int")
    assert [(r["path"], r["score"]) for r in evolution.read_first(rf).collect()] == [("a", 6.0), ("b", 0.0)]


def test_coverage_formats(spark):
    texts = ["mode: set\na/b.go:3.1,4.2 1 1\n", "TN:\nSF:x.ts\nDA:1,0\nDA:2,5\nend_of_record\n", '<coverage><packages><class filename="c.py"><lines><line number="7" hits="2"/></lines></class></packages></coverage>', '{"files": {"d.py": {"executed_lines": [1], "missing_lines": [2]}}}', '{"e.js": {"statementMap": {"0": {"start": {"line": 4}, "end": {"line": 4}}}, "s": {"0": 0}}}', "", None, "{broken", "words"]
    got = {tuple(r) for r in coverage.read(spark.createDataFrame([(t,) for t in texts], "content string")).collect()}
    assert got == {("a/b.go", 3, True, "go"), ("a/b.go", 4, True, "go"), ("x.ts", 1, False, "lcov"), ("x.ts", 2, True, "lcov"), ("c.py", 7, True, "cobertura"), ("d.py", 1, True, "coverage.py"), ("d.py", 2, False, "coverage.py"), ("e.js", 4, False, "istanbul")}


def test_manifests():
    p = manifests.parse
    assert p("package.json", '{"dependencies": {"a": "^1"}}') == [("npm", "a", "^1")]
    assert p("x/go.mod", "module m\nrequire github.com/a/b v1.2.3\n") == [("go", "github.com/a/b", "v1.2.3")]
    assert p("Cargo.toml", '[dependencies]\nserde = "1"\n') == [("cargo", "serde", "1")]
    assert p("pyproject.toml", '[project]\ndependencies = ["x>=1"]\n') == [("python", "x", ">=1")]
    assert p("requirements.txt", "# c\nx==1\n") == [("python", "x", "==1")]
    assert p("package.json", "{") == [] and p("other.txt", "x") == [] and p("go.mod", None) == []


def test_sarif(spark, tmp_path):
    f = spark.createDataFrame([("r1", "HIGH", "n", "a.py", 3, "x"), ("r2", "LOW", None, "b.py", 0, None)], "rule_id string, severity string, name string, path string, line_no int, snippet string")
    assert sinks.write_sarif(f, str(tmp_path / "o.sarif")) == 2
    log = json.loads((tmp_path / "o.sarif").read_text())
    assert {r["level"] for r in log["runs"][0]["results"]} == {"error", "note"} and log["version"] == "2.1.0"
    assert sinks.write_sarif(f.limit(0), str(tmp_path / "e.sarif")) == 0 and json.loads((tmp_path / "e.sarif").read_text())
    assert "| r1 |" in sinks.markdown(f.orderBy("rule_id"), "t")


def test_partitions_do_not_change_results(spark, sf):
    from lodestrata.plans.queries import QUERIES

    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(repr, QUERIES["churn_top"][0](spark, sf).collect())))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_architecture(spark):
    from lodestrata.operators import architecture as A

    t = spark.createDataFrame([("UserViewModel",), ("OrderViewModel",), ("AppCoordinator",), ("Plain",)], "name string")
    assert {r["pattern"]: r["score"] for r in A.pattern_scores(t).collect()} == {"MVVM": 0.75}
    m = spark.createDataFrame([("OrderEntity", 2, 3), ("Bag", 0, 4)], "name string, methods int, fields int")
    f = spark.createDataFrame([("src/domain/a.go",), ("src/infra/b.go",)], "rel_path string")
    r = A.domain_model(m, f).first()
    assert (r["rich"], r["anemic"], r["tactics"]) == (1, 1, 1) and r["score"] == pytest.approx(100 * (0.4 * 0.5 + 0.35 * 0.2 + 0.25 * 0.75), abs=0.01)
    d = spark.createDataFrame([("protocol", False), ("struct", False), ("class", True)], "kind string, has_base boolean")
    assert A.protocol_orientation(d).first()["score"] == pytest.approx(70.0)
    a = spark.createDataFrame([("queue", "x"), ("queue", "y")], "kind string, key string")
    b = spark.createDataFrame([("queue", "y"), ("queue", "z")], "kind string, key string")
    assert {tuple(r) for r in A.drift(a, b).collect()} == {("queue", "x", "not running"), ("queue", "z", "not declared")}
    c = code(spark, "import flask\nfrom sqlalchemy.orm import x\n")
    assert {r["technology"] for r in A.technologies(symbols.imports(c)).collect()} == {"Flask", "SQLAlchemy"}


def test_level_ladder(spark):
    from lodestrata.operators.scoring import ladder

    df = spark.createDataFrame([(0, 0), (20, 5), (54, 10), (70, 60), (70, 61), (84, 74), (93, 99), (93, 98)], "score int, least int")
    got = [r[0] for r in df.select(ladder(F.col("score"), F.col("least"), F.lit(100))).collect()]
    assert got == ["Trainee", "Junior−", "Junior+ / Middle−", "Middle+ / Senior−", "Senior", "Senior+ / Lead−", "Architect", "Lead"]


@pytest.mark.parametrize(
    "rule, language, fire, safe",
    [
        ("go.timer_stop", "go", "t := time.NewTimer(d)", "t := time.NewTimer(d)\ndefer t.Stop()"), ("go.sql_rows", "go", "r, e := db.Query(q)", "r, e := db.Query(q)\ndefer r.Close()"), ("py.popen_handle", "python", "p = subprocess.Popen(c)", "p = subprocess.Popen(c)\np.wait()"), ("java.resultset_leak", "java", "ResultSet r = s.executeQuery(q);", "ResultSet r = s.executeQuery(q);\nr.close();"),
        ("ts.timeout_leak", "ts", "setTimeout(f)\n" * 5, "setTimeout(f)\n" * 4), ("ts.raf_leak", "ts", "requestAnimationFrame(f)", "requestAnimationFrame(f)\ncancelAnimationFrame(h)"), ("rust.thread_join", "rust", "let h = thread::spawn(f);", "let h = thread::spawn(f);\nh.join();"),
    ],
)
def test_leak_rules(spark, rule, language, fire, safe):
    files = spark.createDataFrame([(0, language, False, fire), (1, language, False, safe)], "file_id long, language_id string, is_test boolean, content string")
    got = {(r["file_id"], r["rule_id"]) for r in leaks.leaks(L.code_lines(files, "content", "file_id", "language_id", "is_test")).collect()}
    assert (0, rule) in got and (1, rule) not in got


@pytest.mark.parametrize("path, want", [("a/api/x_test.go", "Tests"), ("cmd/auth/x.go", "CLI / Entry"), ("x/auth/api.go", "Auth / Security"), ("api/v1.proto", "API / Handlers"), ("a/models/dao/x.py", "Models / Schemas"), ("x.py", "Other"), ("lib/main.py", "CLI / Entry"), (None, "Other")])
def test_layers(spark, path, want):
    from lodestrata.operators.symbols import layer

    assert spark.createDataFrame([(path,)], "p string").select(layer(F.col("p"))).first()[0] == want


def test_rule_literals():
    from lodestrata.operators import rules as R

    assert R.needed(r"\bfoo\(bar|baz") == () or set(R.needed(r"foo\(")) == {"foo("}
    assert set(R.needed(r"(?i)\b(strcpy|STRCAT)\s*\(")) == {"strcpy", "strcat"} and R.needed(r"\w+") == ()
    import re

    pattern = re.compile(R.any_of(["ab", "abc", "x.y", "b"]))
    assert all(pattern.search(t) for t in ("zab", "x.y", "b")) and not pattern.search("xzy a")


def test_windows(spark):
    from lodestrata.operators import windows

    text = "if a {\n}\nf := open(x)\n\n\n\n\nclose(f)\nimport http\nhttp.get(y)\n"
    f = spark.createDataFrame([(1, "go", False, text), (2, "go", False, "http.get(y)\n"), (3, "go", False, ""), (4, "go", False, None)], "file_id long, language_id string, is_test boolean, content string")
    c = L.code_lines(f, "content", "file_id", "language_id", "is_test")
    assert {(r["line_no"], r["depth"]) for r in windows.brace_depth(c).filter("file_id = 1 AND line_no < 4").collect()} == {(1, 0), (2, 1), (3, 0)}
    assert [(r["file_id"], r["line_no"]) for r in windows.next_line(c, r"\{\s*$", r"^\}").collect()] == [(1, 1)]
    assert [r["line_no"] for r in windows.unpaired(c, r"open\(", r"close\(").collect()] == [3]
    assert [(r["file_id"], r["line_no"]) for r in windows.gated(c, r"^import http", r"http\.get").collect()] == [(1, 10)]


def test_report_relations(spark):
    from lodestrata.operators import report

    ages = spark.range(1).select(*(report.age(F.lit(s)) for s in (59, 3600, 90000, 40 * 86400, 800 * 86400))).first()
    assert list(ages) == ["0min ago", "1h ago", "1d ago", "1mo ago", "2y ago"]
    r = spark.createDataFrame([("a", "LOW"), ("b", "HIGH"), ("c", None)], "rule_id string, severity string")
    o = spark.createDataFrame([("a", "HIGH"), ("b", "off"), ("z", "LOW")], "rule_id string, severity string")
    assert {tuple(x) for x in report.overlaid(r, o).collect()} == {("a", "HIGH")}
    t = spark.createDataFrame([("x" * 81,), ("é" * 80,), (None,)], "t string")
    assert [x[0] and len(x[0]) for x in t.select(report.shortened("t")).collect()] == [80, 80, None]


def test_culture(spark):
    from lodestrata.operators import culture

    row = (1.0, 3, 4, 0, 100, 0, 0.0, 0, 0, 0, 0, 0, 70)
    df = spark.createDataFrame([row], "kloc double, structures int, algorithms int, god int, longest int, todos int, issue_points double, high int, medium int, cubes int, squares int, leaks int, design int")
    r = culture.rows(df).first()
    assert r["security"] == 100 and r["quality"] == int(0.17 * 55 + 0.13 * 80 + 20 + 50 + 0.5) and r["performance"] == int(0.85 * 80 + 15 + 0.5) and r["level"] == "Senior+ / Lead−"
    p = spark.createDataFrame([("r", 80.5, 100), ("r", 50.0, 300)], "repo string, overall double, loc int")
    assert culture.repo_level(p, "repo").first()["overall"] == 57


def test_suffix_attach_of_repeated_names(spark, monkeypatch):
    from lodestrata.plans import queries

    f = spark.createDataFrame([(1, "core/api/mod.rs"), (2, "core/db/mod.rs"), (3, "a/only.rs"), (4, "x/t/main.go"), (5, "y/t/main.go")], "file_id long, rel_path string")
    paths = spark.createDataFrame([("build/core/api/mod.rs",), ("db/mod.rs",), ("b/only.rs",), ("t/main.go",), ("none.rs",)], "rel_path string")
    monkeypatch.setattr(queries, "files", lambda *_: f)
    monkeypatch.setattr(queries, "table", lambda *_: paths)
    assert sorted(tuple(r) for r in queries.suffix_attach(spark, "").collect()) == [("b/only.rs", 3), ("build/core/api/mod.rs", 1), ("db/mod.rs", 2)]


def test_route_coverage_of_all_operations(spark, monkeypatch):
    from lodestrata.plans import queries

    docs = spark.createDataFrame([(2, "Ids\nGET /a\nPOST /b/{id}\nGET /c\n"), (1, "POST /b/{x}\nGET /d\n"), (3, None)], "doc_id long, text string")
    lines = spark.createDataFrame([(1, 1, "ts", "app.get('/a', f)", False), (1, 2, "ts", "app.delete('/e', f)", False)], "file_id long, line_no int, language_id string, raw string, comment boolean")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    monkeypatch.setattr(queries, "code", lambda *_: lines)
    rows = lambda q: sorted(tuple(r) for r in q(spark, "").collect())
    assert rows(queries.route_coverage) == [("GET", "/a", "missing"), ("GET", "/c", "missing"), ("GET", "/d", "extra"), ("POST", "/b/{}", "covered")]
    assert rows(queries.served_coverage) == [("DELETE", "/e", "extra"), ("GET", "/a", "covered"), ("GET", "/c", "missing"), ("GET", "/d", "missing"), ("POST", "/b/{}", "missing")]
