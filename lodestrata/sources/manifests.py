"""Dependency manifests as a table (file_id, manifest, name, version)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_id long, manifest string, name string, version string"


def package_json(text: str) -> Iterator[tuple[str, str]]:
    data = json.loads(text)
    for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        yield from (data.get(part) or {}).items()


def go_mod(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)", text, re.M):
        yield m[1], m[2]


def toml_tables(text: str, *tables: str) -> Iterator[tuple[str, str]]:
    import tomllib

    data = tomllib.loads(text)
    for table in tables:
        node = data
        for part in table.split("."):
            node = node.get(part, {}) if isinstance(node, dict) else {}
        if isinstance(node, dict):
            for k, v in node.items():
                yield k, v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""
        elif isinstance(node, list):
            for x in node:
                m = re.match(r"([\w.-]+)(?:\[[^\]]*\])?\s*(.*)", x)
                yield m[1], m[2]


def requirements(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*((?:[=<>~!]=?[^#;\s]+\s*,?\s*)*)", text, re.M):
        yield m[1], m[2].strip()


def pom(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"<dependency>.*?<groupId>(.*?)</groupId>\s*<artifactId>(.*?)</artifactId>(?:\s*<version>(.*?)</version>)?", text, re.S):
        yield f"{m[1]}:{m[2]}", m[3] or ""


def gradle(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt)\s*\(?\s*[\"']([^:\"']+:[^:\"']+):([^\"']+)[\"']", text):
        yield m[1], m[2]


def swift_package(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"\.package\(\s*url:\s*\"([^\"]+)\"\s*,\s*(?:from|exact):\s*\"([^\"]+)\"", text):
        yield m[1], m[2]


def podfile_lock(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"^  - ([\w./+-]+) \(([\d.][^)]*)\)", text, re.M):
        yield m[1], m[2]


def cmake(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"find_package\(\s*(\w+)(?:\s+([\d.]+))?", text, re.I):
        yield m[1], m[2] or ""


def compose(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"^\s+image:\s*[\"']?([^\s:\"']+)(?::([^\s\"']+))?", text, re.M):
        yield m[1], m[2] or "latest"


READERS = {
    r"(^|/)package\.json$": ("npm", package_json),
    r"(^|/)go\.mod$": ("go", go_mod),
    r"(^|/)pyproject\.toml$": ("python", lambda t: toml_tables(t, "project.dependencies", "tool.poetry.dependencies")),
    r"(^|/)requirements[\w.-]*\.txt$": ("python", requirements),
    r"(^|/)Cargo\.toml$": ("cargo", lambda t: toml_tables(t, "dependencies", "dev-dependencies")),
    r"(^|/)pom\.xml$": ("maven", pom),
    r"\.gradle(\.kts)?$": ("gradle", gradle),
    r"(^|/)Package\.swift$": ("swiftpm", swift_package),
    r"(^|/)Podfile\.lock$": ("cocoapods", podfile_lock),
    r"(^|/)CMakeLists\.txt$": ("cmake", cmake),
    r"(^|/)(docker-)?compose[\w.-]*\.ya?ml$": ("compose", compose),
}


def parse(path: str, text: str | None) -> list[tuple[str, str, str]]:
    """(manifest, name, version) of a manifest; none for other paths and broken ones."""
    for pattern, (kind, reader) in READERS.items():
        if text and re.search(pattern, path):
            try:
                return [(kind, n, str(v or "")) for n, v in reader(text) if n]
            except (ValueError, AttributeError, TypeError):
                return []
    return []


def read(files: DataFrame) -> DataFrame:
    """Dependencies of the manifests among files (file_id, rel_path, content)."""
    wanted = files.filter(F.col("rel_path").rlike("|".join(READERS)) & F.col("content").isNotNull()).select("file_id", "rel_path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, *x) for i, p, t in zip(pdf["file_id"], pdf["rel_path"], pdf["content"], strict=True) for x in parse(p, t)]
            if rows:
                yield pd.DataFrame(rows, columns=["file_id", "manifest", "name", "version"])

    return wanted.mapInPandas(run, SCHEMA)
