"""YAML and JSON documents as rows of nodes with their lines.

(doc_id, doc_no, json_path, kind, value, line_no); kind is map, list, scalar or
alias. A map or list that anchors repeat is given once; its other places are
aliases whose value is its path, so rows are bounded by the text.
Keys that are plain names come as .name, others as ['key'] with quotes escaped;
members of ``paths`` always come quoted. Needs PyYAML; JSON is read as YAML.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, doc_no int, json_path string, kind string, value string, line_no int"
_PLAIN = re.compile(r"^[A-Za-z_][\w-]*$")


def _step(parent: str, key: str) -> str:
    if _PLAIN.match(key) and parent != "$.paths":
        return f"{parent}.{key}"
    return f"{parent}['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def nodes(text: str | None) -> Iterator[tuple[int, str, str, str | None, int]]:
    """Nodes of all documents of a text; none for null, empty and broken ones."""
    try:
        import yaml
    except ImportError:  # pragma: no cover
        raise RuntimeError("reading YAML needs PyYAML") from None
    if not text:
        return
    out: list[tuple[int, str, str, str | None, int]] = []
    try:
        for doc_no, root in enumerate(yaml.compose_all(text, Loader=yaml.SafeLoader)):
            todo = [("$", root)] if root else []
            met: dict[int, str] = {}  # nodes that were given, with their paths
            while todo:
                path, node = todo.pop()
                line = node.start_mark.line + 1
                if not isinstance(node, yaml.ScalarNode) and id(node) in met:
                    out.append((doc_no, path, "alias", met[id(node)], line))
                    continue
                met[id(node)] = path
                if isinstance(node, yaml.MappingNode):
                    out.append((doc_no, path, "map", None, line))
                    todo += [(_step(path, str(k.value)), v) for k, v in reversed(node.value)]
                elif isinstance(node, yaml.SequenceNode):
                    out.append((doc_no, path, "list", None, line))
                    todo += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(node.value)))]
                else:
                    out.append((doc_no, path, "scalar", node.value, line))
    except (yaml.YAMLError, ValueError, RecursionError):
        return
    yield from out


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, *n) for i, t in zip(pdf["doc_id"], pdf["content"], strict=True) for n in nodes(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "doc_no", "json_path", "kind", "value", "line_no"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as content").mapInPandas(run, SCHEMA)
