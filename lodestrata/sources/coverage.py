"""Test coverage artefacts of five formats as one table (path, line_no, hit, source).

artefacts: (path string, content string) of whole files; one narrow stage.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, line_no int, hit boolean, source string"


def go_profile(text: str) -> Iterator[tuple[str, int, bool]]:
    for m in re.finditer(r"^(\S+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$", text, re.M):
        for n in range(int(m[2]), int(m[3]) + 1):
            yield m[1], n, m[4] != "0"


def lcov(text: str) -> Iterator[tuple[str, int, bool]]:
    path = ""
    for line in text.splitlines():
        if line.startswith("SF:"):
            path = line[3:]
        elif line.startswith("DA:"):
            n, hits = line[3:].split(",")[:2]
            yield path, int(n), int(hits) > 0


def cobertura(text: str) -> Iterator[tuple[str, int, bool]]:
    for c in ET.fromstring(text).iter("class"):
        for x in c.iter("line"):
            yield c.get("filename", ""), int(x.get("number", 0)), x.get("hits", "0") != "0"


def coverage_py(data: dict) -> Iterator[tuple[str, int, bool]]:
    for path, f in data["files"].items():
        for n in f.get("executed_lines", []):
            yield path, n, True
        for n in f.get("missing_lines", []):
            yield path, n, False


def istanbul(data: dict) -> Iterator[tuple[str, int, bool]]:
    for path, f in data.items():
        for k, place in f.get("statementMap", {}).items():
            for n in range(place["start"]["line"], place["end"]["line"] + 1):
                yield path, n, f.get("s", {}).get(k, 0) > 0


def parse(text: str | None) -> Iterator[tuple[str, int, bool, str]]:
    """Rows of an artefact, whatever its format; none for null, empty and unknown ones."""
    text = (text or "").lstrip("﻿ \n")
    kind, rows = None, ()
    try:
        if text.startswith("mode:"):
            kind, rows = "go", go_profile(text)
        elif re.search(r"^(TN:|SF:)", text, re.M) and "DA:" in text:
            kind, rows = "lcov", lcov(text)
        elif text.startswith("<"):
            kind, rows = "cobertura", cobertura(text)
        elif text.startswith("{"):
            data = json.loads(text)
            kind, rows = ("coverage.py", coverage_py(data)) if "files" in data else ("istanbul", istanbul(data))
        for r in rows:
            yield *r, kind
    except (ValueError, KeyError, TypeError, AttributeError, ET.ParseError):
        return


def read(artefacts: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for text in pdf["content"]:
                rows = list(parse(text))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "line_no", "hit", "source"])

    return artefacts.select("content").mapInPandas(run, SCHEMA)
