"""Version-control history as a Python data source.

``spark.dataSource.register(GitLog)`` then
``spark.read.format("git_log").option("path", repo).option("kind", "commits" | "files").load()``.
Rows stream out of one ``git log`` a repository; paths may name several
repositories by commas, one partition each.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS = "repo string, sha string, author string, ts timestamp, subject string, is_merge boolean"
FILES = "repo string, sha string, rel_path string, added int, deleted int"


class _Repo(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GitLogReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, since: str | None):
        self.paths, self.kind, self.since = paths, kind, since

    def partitions(self) -> list[InputPartition]:
        return [_Repo(p) for p in self.paths]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        repo = partition.path.rstrip("/").rsplit("/", 1)[-1]
        command = ["git", "-C", partition.path, "log", "--no-color", "--format=%x01%H%x02%an%x02%at%x02%P%x02%s"]
        command += ["--numstat", "--no-renames"] if self.kind == "files" else []
        command += [f"--since={self.since}"] if self.since else []
        run = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace")
        sha = ""
        for line in run.stdout:
            line = line.rstrip("\n")
            if line.startswith("\x01"):
                sha, author, at, parents, subject = line[1:].split("\x02", 4)
                if self.kind == "commits":
                    yield repo, sha, author, datetime.fromtimestamp(int(at), timezone.utc), subject, " " in parents
            elif self.kind == "files" and line.count("\t") == 2:
                added, deleted, path = line.split("\t")
                yield repo, sha, path, None if added == "-" else int(added), None if deleted == "-" else int(deleted)
        if run.wait():
            raise RuntimeError(f"git log failed in {partition.path}")


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return FILES if self.options.get("kind") == "files" else COMMITS

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options["path"].split(","), self.options.get("kind", "commits"), self.options.get("since"))


DIFF = "path string, new_start int, new_count int, old_start int"


class GitDiffReader(DataSourceReader):
    """Hunks between two revisions of one repository."""

    def __init__(self, path: str, base: str, head: str):
        self.path, self.base, self.head = path, base, head

    def read(self, partition) -> Iterator[tuple]:
        import re

        out = subprocess.run(["git", "-C", self.path, "diff", "-U0", "--no-color", "--no-renames", self.base, self.head], capture_output=True, text=True, errors="replace", check=True).stdout
        path = ""
        for line in out.splitlines():
            if line.startswith("+++ "):
                path = line[6:] if line.startswith("+++ b/") else ""
            elif path and (m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
                yield path, int(m[2]), int(m[3] or 1), int(m[1])


class GitDiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return DIFF

    def reader(self, schema) -> DataSourceReader:
        return GitDiffReader(self.options["path"], self.options["base"], self.options.get("head", "HEAD"))


BLAME = "rel_path string, line_no int, author string, sha string"


class _File(InputPartition):
    def __init__(self, rel_path: str):
        self.rel_path = rel_path


class GitBlameReader(DataSourceReader):
    """Author and commit of each line of the named files, one partition a file."""

    def __init__(self, path: str, files: list[str]):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        run = subprocess.run(["git", "-C", self.path, "blame", "--line-porcelain", "--", partition.rel_path], capture_output=True, text=True, errors="replace")
        sha, number, author = "", 0, ""
        for line in run.stdout.splitlines():
            if line.startswith("\t"):
                yield partition.rel_path, number, author, sha
            elif line.startswith("author "):
                author = line[7:]
            else:
                head = line.split(" ")
                if len(head) >= 3 and len(head[0]) == 40 and head[2].isdigit():
                    sha, number = head[0], int(head[2])


class GitBlame(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return BLAME

    def reader(self, schema) -> DataSourceReader:
        return GitBlameReader(self.options["path"], self.options["files"].split(","))
