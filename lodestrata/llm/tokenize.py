"""Problem 6: exact ids of a public byte-level BPE for a whole corpus.

Method: per-prefix dynamic programming. A multi-pattern automaton over the
vocabulary's byte strings lists, for every prefix of a pre-token, the tokens
that end there. A token may follow the unique last token of the shorter prefix
only if the pair is compatible, that is, if merging their joined bytes gives
exactly that pair back. By the uniqueness of BPE encodings one token at most
passes for each prefix; back-pointers from the end give the ids.

Pre-tokens repeat a lot in text, so each Python worker keeps a bounded memo from
pre-token to ids; the memo changes speed only, never results.

Defined results: null and empty texts give an empty list; white space is text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_ENTRIES = 200_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of a public vocabulary file of the installed tokenizer package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    """Read a vocabulary of lines ``base64-token rank``."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if parts := line.split():
                ranks[base64.b64decode(parts[0])] = int(parts[1])
    return ranks


class PrefixEncoder:
    """Encodes texts with per-prefix dynamic programming over a rank vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import public_tokenizers
        import regex

        self.ranks = read_ranks(path)
        self.token = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.ends = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.compatible = lru_cache(500_000)(self._compatible)
        self.memo: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Reference merging by lowest rank first; used on joined pairs of tokens only."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens survive merging; left is -1 at the start."""
        if left < 0:
            return self.merged(self.token[right]) == [right]
        return self.merged(self.token[left] + self.token[right]) == [left, right]

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None and self.compatible(-1, whole):
            return [whole]
        n = len(raw)
        last = array("i", [-1]) * (n + 1)  # last[p]: the last token of the prefix of p bytes
        size = array("i", [0]) * (n + 1)
        for at, (length, token) in self._matches(raw):
            p = at + 1
            before = p - length
            if size[p] or (before and not size[before]):
                continue
            if self.compatible(last[before] if before else -1, token):
                last[p], size[p] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _matches(self, raw: bytes) -> Iterator[tuple[int, tuple[int, int]]]:
        return self.ends.iter(raw.decode("latin-1"))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and empty texts."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                if len(piece) <= 64:
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(4)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each vocabulary and Python worker."""
    return PrefixEncoder(path)


def token_ids(column: Column | str, path: str | None = None) -> Column:
    """Column of ids of a text column. Null and empty texts give an empty list."""
    path = path or vocabulary_path()

    @F.pandas_udf(ArrayType(IntegerType(), False))
    def encode(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return texts.map(lambda t: e.encode(t if isinstance(t, str) else None))

    return encode(F.col(column) if isinstance(column, str) else column)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids)`` of every row. One narrow Arrow stage, no shuffle.

    Rows are kept one to one: repeated ids and texts stay. Other columns are not read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):  # small output batches bound a worker's memory
                part = texts.slice(lo, 256)
                flat, offsets = array("i"), array("i", [0])
                for t in part:
                    flat.extend(e.encode(t.as_py()))
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
