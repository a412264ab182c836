"""Problem 7: evaluation passages inside training texts.

Method: spaced-seed hashing. A document holds a passage if at least MIN_WORDS
consecutive words of an item stand in it, of which at most one in ten is
replaced. Three fixed masks of SPAN words each ignore a third of the positions.
Any passage of the definition has, under one of them, a window whose kept words
all agree: a window with one replaced word is caught by the mask that ignores
its third; if every window of the passage has two, the passage has 20 to 29
words with both replacements at most three words apart in its middle, and some
window has both in one third. Longer passages always hold a window with one at
most. So the masks lose nothing, and hits are then verified along their
diagonal: the longest aligned stretch with mismatches <= length / 10.

The evaluation side is the stated query set and travels to the workers in blocks
of about ``max_local_seeds`` seeds, so what is broadcast doesn't grow with it:
each block scans all documents in a narrow stage, and only found pairs are kept.
No seed is shuffled, so boilerplate that a third of the documents holds makes no
hot key, and one block or many give the same rows.

Defined results: null and blank texts or items leak nothing; items shorter than
MIN_WORDS words must occur whole; repeated ids give one row.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.tables import cut

MIN_WORDS = 12
SPAN = 12
#: Each mask keeps eight of twelve positions.
MASKS = tuple(tuple(k for k in range(SPAN) if k // 4 != third) for third in range(3))
#: Seeds of one block of the evaluation side.
MAX_LOCAL_SEEDS = 2_000_000

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]{0,20}(?:\s[^<>]{0,200})?/?>|<!--|-->")
_GONE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_TAIL = "[\u0080-\u00bf\u0152-\u0178\u2013-\u203a\u20ac\u2122]"
_TWICE = re.compile(f"[Â-ß]{_TAIL}|[à-ï]{_TAIL}{{2}}")  # UTF-8 read as a one-byte code
_LINK = re.compile(r"\]\([^()\s]{0,300}\)")


def _once(m: re.Match) -> str:
    try:
        return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in m[0]).decode()
    except UnicodeError:
        return m[0]


def repaired(text: str) -> str:
    """Text with UTF-8 sequences that were read as a one-byte code put right."""
    return _TWICE.sub(_once, text)


def words(text: str | None) -> list[str]:
    """Normalised words: entities, markup, case, accents, punctuation and invisible characters do not matter."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _GONE.sub("", repaired(text)))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


def _number(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in ws), np.uint64, len(ws))


_MUL = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def seeds(numbers: np.ndarray) -> list[np.ndarray]:
    """For each mask the hash of every window of SPAN words."""
    n = len(numbers) - SPAN + 1
    if n <= 0:
        return [np.empty(0, np.uint64) for _ in MASKS]
    thirds = []
    for third in range(3):  # a hash of four words, shared by the masks
        h = np.full(n, third + 1, np.uint64)
        for k in range(4 * third, 4 * third + 4):
            h = (h ^ numbers[k : k + n]) * _MUL[0]
            h ^= h >> np.uint64(29)
        thirds.append(h)
    out = []
    for skip in range(3):
        a, b = (thirds[k] for k in range(3) if k != skip)
        h = (a * _MUL[1] + b) * _MUL[2] + np.uint64(skip)
        out.append(h ^ (h >> np.uint64(31)))
    return out


def verified(doc: np.ndarray, item: np.ndarray, diagonal: int, least: int) -> bool:
    """Whether an aligned stretch of at least ``least`` words has at most a tenth replaced.

    diagonal: document position minus item position.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi - lo < least:
        return False
    bad = np.concatenate(([0], np.cumsum(doc[lo + diagonal : hi + diagonal] != item[lo:hi])))
    # 10 * mismatches <= length, for some pair i <= j - least: a prefix maximum decides
    score = np.arange(len(bad)) - 10 * bad
    best = np.minimum.accumulate(score)
    return bool((score[least:] >= best[: len(score) - least]).any())


class Items:
    """The evaluation side with a sorted seed table, held by each Python worker."""

    def __init__(self, rows: list[tuple[int, str | None]], min_words: int):
        self.ids, self.numbers, hashes, owner, at = [], [], [], [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}  # number of words -> whole item -> its places
        for item_id, text in rows:
            n = _number(words(text))
            if not len(n):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.numbers.append(n)
            if len(n) < SPAN:
                self.short.setdefault(len(n), {}).setdefault(n.tobytes(), []).append(k)
            for h in seeds(n):
                hashes.append(h)
                owner.append(np.full(len(h), k))
                at.append(np.arange(len(h)))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, int))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, int))[order]
        self.min_words = min_words

    def leaks(self, text: str | None) -> list[int]:
        doc = _number(words(text))
        found: set[int] = set()
        tried: set[tuple[int, int]] = set()
        if len(doc) >= SPAN and len(self.hashes):
            for h in seeds(doc):
                left = np.searchsorted(self.hashes, h)
                hit = np.flatnonzero(self.hashes[np.minimum(left, len(self.hashes) - 1)] == h)
                for p in hit:
                    k = int(left[p])
                    while k < len(self.hashes) and self.hashes[k] == h[p]:
                        o, d = int(self.owner[k]), int(p) - int(self.at[k])
                        k += 1
                        if o in found or (o, d) in tried:
                            continue
                        tried.add((o, d))
                        if verified(doc, self.numbers[o], d, min(self.min_words, len(self.numbers[o]))):
                            found.add(o)
        raw = doc.tobytes() if self.short else b""
        for n, whole in self.short.items():
            for p in range(0, len(raw) - 8 * n + 1, 8):
                found.update(whole.get(raw[p : p + 8 * n], ()))
        return [self.ids[o] for o in sorted(found)]


def leaked(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_local_seeds: int = MAX_LOCAL_SEEDS) -> DataFrame:
    """``(doc_id, item_id)`` of every leak.

    docs has doc_id and text, items item_id and text; other columns are not read.
    """
    pairs = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.select("doc_id", "text").filter("text IS NOT NULL")
    size = pairs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-3 * size // (4 * max_local_seeds)))  # three seeds a word, four characters a word at least
    if blocks == 1:
        return _scanned(docs, pairs, min_words)[0].distinct()
    found = None
    for k in range(blocks):
        rows, shared = _scanned(docs, pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), min_words)
        rows = cut(rows.distinct())
        shared.unpersist()
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def _scanned(docs: DataFrame, block: DataFrame, min_words: int) -> tuple[DataFrame, Broadcast]:
    """The leaks of one block of items in all documents, and what was broadcast for it."""
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Items(shared.value, min_words)
        for batch in batches:
            docs_out, items_out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i in table.leaks(text.as_py()):
                    docs_out.append(doc_id)
                    items_out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(docs_out, pa.int64()), pa.array(items_out, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(scan, "doc_id long, item_id long"), shared
