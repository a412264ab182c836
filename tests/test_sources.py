"""Readers of trees and history, and the streaming plans."""

import subprocess

from pyspark.sql import functions as F


def test_tree(spark, tmp_path):
    from lodestrata.sources import tree

    for p, t in {"a/x.py": "x = 1\n", "a/test_x.py": "t = 1\n", "a/empty.py": "", "node_modules/y.js": "y", ".git/z.py": "z", "go.mod": "module m\n", "b/go.mod": "module b\n", "b/c/d.go": "package c\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    f = tree.read_tree(spark, str(tmp_path), "r")
    got = {r["rel_path"]: r for r in f.collect()}
    assert set(got) == {"a/x.py", "a/test_x.py", "go.mod", "b/go.mod", "b/c/d.go"} and got["a/test_x.py"]["is_test"] and got["a/x.py"]["language_id"] == "python"
    roots = tree.nearest_root(f, tree.module_roots(f))
    assert {r["rel_path"]: r["root"] for r in roots.collect()}["b/c/d.go"] == "b"


def test_git_log(spark, tmp_path):
    from lodestrata.sources.git_log import GitLog

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-qm", "feat: one")
    spark.dataSource.register(GitLog)
    c = spark.read.format("git_log").option("path", str(tmp_path)).load().collect()
    f = spark.read.format("git_log").option("path", str(tmp_path)).option("kind", "files").load().collect()
    assert [(x["author"], x["subject"], x["is_merge"]) for x in c] == [("n", "feat: one", False)] and [(x["rel_path"], x["added"]) for x in f] == [("a.txt", 2)]


def test_git_diff_and_blame(spark, tmp_path):
    from lodestrata.sources.git_log import GitBlame, GitDiff

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("1\n2\n", "1\n2\n3\n"):
        (tmp_path / "a.txt").write_text(text)
        git("add", ".")
        git("commit", "-qm", "x")
    spark.dataSource.register(GitDiff)
    spark.dataSource.register(GitBlame)
    d = spark.read.format("git_diff").option("path", str(tmp_path)).option("base", "HEAD~1").load().collect()
    b = spark.read.format("git_blame").option("path", str(tmp_path)).option("files", "a.txt").load().collect()
    assert [tuple(x) for x in d] == [("a.txt", 3, 1, 2)] and [(x["line_no"], x["author"]) for x in b] == [(1, "n"), (2, "n"), (3, "n")] and b[0]["sha"] != b[2]["sha"]


def test_stream(spark, tmp_path):
    from lodestrata.operators.rule_tables import SECURITY
    from lodestrata.streaming.rules_stream import stream_findings

    schema = "file_id long, language_id string, is_test boolean, content string"
    spark.createDataFrame([(1, "python", False, "x = eval(y)\n")], schema).write.parquet(str(tmp_path / "in"))
    s = stream_findings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), SECURITY)
    q = s.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["rule_id"] for r in spark.sql("select * from found where rule_id like '%eval%'").collect()] == ["python.eval_exec"]


def test_windowed_stream(spark, tmp_path):
    from lodestrata.streaming.rules_stream import windowed_counts

    df = spark.createDataFrame([(1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 02:00:00", "a", 2.0), (3, "2024-01-05 00:00:00", "a", 1.0)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    s = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 hour", "1 day", "event_type")
    q = s.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.sql("select * from windows").collect()] == [(2, 3.0)]


def test_entry_without_llm(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 14 and set(e.oracle_sql()) <= set(e.queries())
