"""Problem 5: source files that do not parse.

Method: each file is parsed against every supported grammar, its own and the
others. Where several take it, languages are ranked by the weight of their own
words and signs among the tokens. A file that its own grammar refuses has a wrong
extension if a foreign one takes it (the likeliest by rank), and is corrupt if
none does. Most foreign grammars are ruled out by a text's first tokens; that
changes no verdict (see ``begins_wrong``). Python is parsed by the running
interpreter, the brace languages by the parsers of grammars.py.

One narrow stage, with no shuffle but for the rates. The interpreter keeps every
name that its parser has read for as long as it runs, so each batch is parsed in a
process of its own (see ``apart``); a worker's memory doesn't grow with the table.

Defined results: null or empty content and null or unknown languages have no
verdict (valid is null); texts nested deeper than interpreter or compilers take
are invalid, with that reason.
"""

from __future__ import annotations

import os
import pickle
import re
import traceback
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.grammars import LANGUAGES, fails, parses
from lodestrata.llm.lexers import KEYWORDS

_WORDS = {**KEYWORDS, "python": frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False self".split())}
_TOKEN = re.compile(r"[^\W\d]\w*|:=|=>|->|::|[{};]")
_SIGNS = {"go": {":=": 3}, "ts": {"=>": 3, ";": 1, "{": 1}, "rust": {"::": 2, "->": 2, ";": 1, "{": 1}, "java": {";": 1, "{": 1}, "python": {"->": 1}}


def ranking(text: str, without: str | None = None) -> list[str]:
    """Languages by the weight of their words and signs in a text, the likeliest first."""
    counts = Counter(_TOKEN.findall(text))
    score = {lang: sum(n for t, n in counts.items() if t in _WORDS[lang]) + sum(w * counts[s] for s, w in _SIGNS[lang].items()) for lang in LANGUAGES}
    return sorted((lang for lang in LANGUAGES if lang != without), key=lambda lang: -score[lang])


def verdict(language: str | None, text: str | None) -> tuple[bool | None, str | None, str | None, list[str] | None]:
    """(valid, the language it parses as instead, why it fails, all languages it parses as)."""
    if language not in LANGUAGES or not text:
        return None, None, None, None
    why = fails(language, text)
    others = [lang for lang in LANGUAGES if lang != language and text.strip() and parses(text, lang)]
    taken = [*others, language] if why is None else others
    if len(taken) > 1:
        order = ranking(text)
        taken.sort(key=order.index)
    return why is None, None if why is None or not taken else taken[0], why, taken


def apart(work: Callable[[], Any]) -> Any:
    """The result of ``work``, done in a forked process that ends with it; its errors are raised here."""
    if not hasattr(os, "fork"):
        return work()
    source, sink = os.pipe()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)  # of threads; the child uses none
        pid = os.fork()
    if not pid:
        status = 1
        try:
            os.close(source)
            try:
                said = True, work()
            except Exception:
                said = False, traceback.format_exc()
            with open(sink, "wb") as f:
                pickle.dump(said, f)
            status = 0
        finally:
            os._exit(status)
    os.close(sink)
    try:
        with open(source, "rb") as f:
            said = f.read()
    finally:
        status = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
    if status:
        raise RuntimeError(f"the parsing process ended with {status}")
    done, result = pickle.loads(said)
    if not done:
        raise RuntimeError(f"the parsing process failed:\n{result}")
    return result


def verdicts(languages: pa.Array, texts: pa.Array) -> list[tuple[bool | None, str | None, str | None, list[str] | None]]:
    """The verdict of each text of a batch."""
    return apart(lambda: [verdict(lang.as_py(), text.as_py()) for lang, text in zip(languages, texts, strict=True)])


def parsed(files: DataFrame) -> DataFrame:
    """``(file_id, valid, foreign, reason, parses)`` for every row; ``parses`` lists every language whose grammar takes the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = verdicts(batch.column(1), batch.column(2))
            kinds = (pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["file_id", "valid", "foreign", "reason", "parses"])

    return files.select("file_id", "language_id", "content").mapInArrow(run, "file_id long, valid boolean, foreign string, reason string, parses array<string>")


def rates(files: DataFrame) -> DataFrame:
    """Per repo and language: files with a verdict, invalid ones, wrong extensions and the invalid share. A repeated id counts once."""
    verdicts = parsed(files).groupBy("file_id").agg(F.bool_and("valid").alias("valid"), F.min("foreign").alias("foreign"))
    own = files.select("file_id", "repo", "language_id").dropDuplicates(["file_id"])
    joined = own.join(verdicts.filter("valid IS NOT NULL"), "file_id")
    bad = (~F.col("valid")).cast("long")
    return joined.groupBy("repo", "language_id").agg(F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.count("foreign").alias("wrong_extension"), F.round(F.avg(bad), 6).alias("rate"))
