"""Problem 4: generated, minified, vendored and data-only source files.

Method: thresholds on layout statistics of each file, tuned for each language
(LAYOUT): mean line length, over-long lines and what stands in them, white-space
share, share of letters and digits, number literals, long encoded runs, variety
of line shapes, share of accessor lines. Where layout tells nothing, the marks
that tools and third parties leave are further evidence: banners that say the
file itself was made or copied, and the folders that package managers and people
keep third-party code in. Words about generated or vendored things elsewhere
("reads files that ... has generated") are no banner.

Layout is judged in one narrow stage: counts are taken on bytes and nothing is
shuffled but ids.

Copies of third-party files that carry neither banner nor folder are found by a
second stage: MinHash signatures of five-word shingles, joined by bands with
those of the files known to be vendored; a similarity of 0.8 or more tells a
copy. Files of equal signatures are one on both sides, so a library with many
copies costs no more; an unmarked signature is compared with every known one of
its bucket, and no pairs within a side are formed. Signatures only choose
candidates: a pair whose estimate lies within three standard errors of the limit
is settled by its exact shingle sets. A pair of similarity 0.8 shares a band with
probability 0.9998 and is a candidate with 0.998.

Defined results: null or empty content is judged by its path alone; a null
language (configuration) is never flagged; repeated ids give one row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.tables import cut

# Fixed word lists.
THIRD_PARTY_FOLDERS = frozenset("vendor third_party third-party thirdparty node_modules bower_components 3rd 3rdparty contrib deps external externals Pods Carthage site-packages jspm_packages Godeps".split())
GENERATED_NAMES = re.compile(r"(?:\.pb\.(?:go|cc|h|ts|js)|_pb2(?:_grpc)?\.py|\.g\.(?:ts|js|dart|cs)|_generated\.\w+|\.generated\.\w+|_bindings\.rs|Grpc\.java|\.designer\.\w+)$")
MINIFIED_NAMES = re.compile(r"[.-]min\.(?:js|css|ts)$")

MADE = re.compile(
    r"^(?:(?:this|the) (?:file|code|module|class|source) (?:is|was|has been) )?(?:<auto-?generated|@generated\b|(?:auto-?|automatically |machine[- ])?(?:generated|created|produced|written|built) (?:by|from|with|using)\b|autogenerated\b|auto-?generated(?! (?:stubs|files|code) (?:live|are)))"
    r"|^\W*(?:code |\S+ )?generated by \S+.{0,20}(?:do not (?:edit|modify)|$)|^do not (?:edit|modify)(?: this file)?(?:\s*[:!.-]|$)|\b(?:edits|changes) will be (?:over-?written|lost)\b|machine-written by|\bautogenerated - "
    r"|^(?:erzeugt|generiert|erstellt) (?:von|durch|mit|aus)\b.*(?:nicht|$)|nicht von hand (?:andern|bearbeiten)|^(?:fichier )?genere (?:par|automatiquement)|ne pas (?:modifier|editer)|^(?:archivo )?generado (?:por|automaticamente)|no (?:editar|modificar)\b|^(?:arquivo )?gerado por|nao edit[ae]",
    re.I,
)
COPIED = re.compile(r"taken from upstream|^imported from (?:https?|git|ssh)\S*|(?:copied|vendored|imported) (?:verbatim )?from upstream|^@license\b|^@preserve\b|released by the \S+ authors under its own terms|released under its own terms", re.I)
BANG = re.compile(r"^\s*/\*!")
_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+/?|--|;+|<!--|\"\"\"|''')\s*(.*?)\s*(?:\*/|-->|\"\"\")?\s*$")
_LINE = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")
_OPENS = re.compile(r"\s*(/\*|<!--|\"\"\"|''')")
_ENDS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_ACCESSOR = re.compile(rb"return (?:this|self|&self|&?\w)\.\w+;?[ \t\r]*\n|`json:\"|\n[ \t]*&?self\.\w+(?:\.clone\(\))?[ \t\r]*\n|return self\._\w+\[")
_RUN = re.compile(rb"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){10,}")
_NUMBER = re.compile(rb"(?<![A-Za-z_0-9.])(?:0x)?[0-9a-fA-F]*[0-9][0-9a-fA-F.]*")
_WORD_RUN = re.compile(rb"a+")
_SHAPE = bytes(97 if chr(c).isalnum() or c == 95 or c >= 128 else c for c in range(256))
_SHAPE_DOTTED = bytes(97 if c == 46 else x for c, x in enumerate(_SHAPE))
_ACCENTS = str.maketrans("áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC")

class Limits(NamedTuple):
    """Thresholds of a language's layout."""

    mean: float  # least mean line length of minified text
    space: float  # most share of white space in it
    wide: int  # length from which a line counts as over-long
    numbers: float  # least share of number literals among the words of data
    encoded: float  # least share of long encoded runs in data
    alnum: float  # least share of letters and digits of data that is one run
    accessors: float  # least share of accessor lines of made classes
    shapes: float  # most share of different line shapes in them


#: By language. Each limit lies between hand-written and other files of that language, as counted on the unmarked files
#: of a sample: twice the greatest mean of hand-written lines, the white space of their sparsest twentieth, and the
#: middle between the two sides for the shares.
LAYOUT = {
    "go": Limits(130, 0.12, 1000, 0.50, 0.72, 0.92, 0.19, 0.34),
    "java": Limits(155, 0.20, 1000, 0.64, 0.77, 0.94, 0.20, 0.34),
    "python": Limits(160, 0.15, 1000, 0.65, 0.75, 0.94, 0.20, 0.34),
    "rust": Limits(245, 0.16, 1000, 0.50, 0.70, 0.90, 0.20, 0.34),
    "ts": Limits(155, 0.14, 1000, 0.65, 0.77, 0.94, 0.20, 0.34),
}
#: For other languages the loosest of each.
OTHERS = Limits(245, 0.12, 1000, 0.65, 0.77, 0.94, 0.20, 0.34)
#: Least share of a file's text that stands in its over-long lines where those alone are minified.
WIDE_SHARE = 0.5
#: Least share of accessor lines in any language; below it line shapes are not counted.
ACCESSORS_FROM = 0.19
#: Least mean line length of data that is one run of letters and digits.
RUN = 60


def _comments(text: str) -> Iterator[tuple[str, str]]:
    """Lines of the comments before the first code: as they stand, and what they say without marks."""
    end = None  # the mark that ends the open block
    for m in _LINE.finditer(text):
        rest = m[0]
        while rest.strip():
            opens = _OPENS.match(rest) if end is None else None
            if end is None and not opens:
                said = _COMMENT.match(rest)
                if not said:
                    return
                yield rest, said[1]
                break
            if opens:
                end = _ENDS[opens[1]]
            close = rest.find(end, opens.end() if opens else 0)
            piece, rest = (rest, "") if close < 0 else (rest[:close], rest[close + len(end) :])
            said = _COMMENT.match(piece)
            yield piece, said[1] if said else piece.strip()
            if close >= 0:
                end = None


def banner(text: str) -> str | None:
    """'generated' or 'vendored' if the comments before the code say so of this file."""
    for line, said in _comments(text):
        if BANG.match(line):
            return "vendored"
        said = said.translate(_ACCENTS)
        if MADE.search(said):
            return "generated"
        if COPIED.search(said):
            return "vendored"
    return None


def statistics(text: str, wide: int = 1000) -> dict[str, float]:
    """Layout statistics of a text; lines without content do not count. ``wide`` is the length of an over-long line."""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b == 10)
    begins = np.concatenate(([0], ends + 1))
    sizes = np.diff(np.concatenate(([-1], ends, [len(b)]))) - 1
    begins, sizes = begins[sizes > 0], sizes[sizes > 0]
    n = max(1, len(b))
    space = int(((b == 32) | (b == 9) | (b == 10) | (b == 13)).sum())
    digit = int(((b >= 48) & (b <= 57)).sum())
    alpha = int((((b | 32) >= 97) & ((b | 32) <= 122)).sum())
    out = {"lines": len(sizes), "mean": float(sizes.mean()) if len(sizes) else 0.0, "max": int(sizes.max()) if len(sizes) else 0, "space": space / n, "alnum": (digit + alpha) / n, "digits": digit / n}
    long = np.flatnonzero(sizes >= wide)
    out["wide"], out["wide_space"], out["wide_alnum"] = int(sizes[long].sum()) / n, 0.0, 0.0
    if len(long):
        said = b"".join(raw[begins[k] : begins[k] + sizes[k]] for k in long)
        c = np.frombuffer(said, np.uint8)
        out["wide_space"] = int(((c == 32) | (c == 9) | (c == 13)).sum()) / len(c)
        out["wide_alnum"] = int(((c >= 48) & (c <= 57) | ((c | 32) >= 97) & ((c | 32) <= 122)).sum()) / len(c)
    out["encoded"] = sum(len(m) for m in _RUN.findall(raw)) / n
    words = len(_WORD_RUN.findall(raw.translate(_SHAPE_DOTTED)))
    out["numbers"] = len(_NUMBER.findall(raw)) / max(1, words) if digit / n > 0.2 else digit / n
    out["shapes"], out["accessors"] = 1.0, 0.0
    if len(sizes) >= 8:
        out["accessors"] = len(_ACCESSOR.findall(raw)) / len(sizes)
        if out["accessors"] >= ACCESSORS_FROM:
            shapes = [s.strip() for s in _WORD_RUN.sub(b"a", raw.translate(_SHAPE)).split(b"\n") if s.strip()]
            out["shapes"] = len(set(shapes)) / max(1, len(shapes))
    return out


def layout(language: str | None, s: dict[str, float]) -> str | None:
    """'minified', 'generated' or 'data' by a file's layout statistics, else None."""
    lim = LAYOUT.get(language, OTHERS)
    if s["encoded"] >= lim.encoded or s["numbers"] >= lim.numbers or s["alnum"] >= lim.alnum and s["space"] <= lim.space / 2 and s["mean"] >= RUN:
        return "data"
    if s["mean"] >= lim.mean and s["space"] <= lim.space or s["wide"] >= WIDE_SHARE and s["wide_space"] <= lim.space / 2 and s["wide_alnum"] < lim.alnum:
        return "minified"
    if s["accessors"] >= lim.accessors and s["shapes"] < lim.shapes:
        return "generated"
    return None


def marked(path: str | None, text: str | None) -> tuple[str | None, str | None]:
    """(kind, evidence) by the marks that tools and third parties leave: folders, names, banners."""
    folders = (path or "").split("/")
    if THIRD_PARTY_FOLDERS.intersection(folders[:-1]):
        return "vendored", "folder"
    if MINIFIED_NAMES.search(folders[-1]):
        return "minified", "name"
    if GENERATED_NAMES.search(folders[-1]):
        return "generated", "name"
    said = banner(text) if text else None
    return said, said and "banner"


def judged(language: str | None, path: str | None, text: str | None) -> tuple[str | None, str | None, str | None]:
    """(kind, evidence, kind by marks): layout first, then marks; kind is None for hand-written files."""
    if language is None:
        return None, None, None
    by_mark, evidence = marked(path, text)
    by_layout = layout(language, statistics(text, LAYOUT.get(language, OTHERS).wide)) if text else None
    return (by_layout, "layout", by_mark) if by_layout else (by_mark, evidence, by_mark)


def kind(language: str | None, path: str | None, text: str | None) -> str | None:
    """'vendored', 'generated', 'minified' or 'data' for a file that isn't hand-written, else None."""
    return judged(language, path, text)[0]


def classified(files: DataFrame) -> DataFrame:
    """``(file_id, kind, evidence)`` for every row; both are null for hand-written files and for configuration.

    evidence is layout, folder, name or banner; layout goes first where several tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judged(lang.as_py(), path.as_py(), text.as_py()) for lang, path, text in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["file_id", "kind", "evidence"])

    return files.select("file_id", "language_id", "file_path", "content").mapInArrow(run, "file_id long, kind string, evidence string")


# --- copies without a mark ---------------------------------------------------
WORDS, SIMILAR, HASHES, BANDS = 5, 0.8, 64, 16
#: Estimated similarity from which a pair is a candidate (three standard errors below SIMILAR), and from which it needs no exact check (three above).
CANDIDATE, SURE = 0.65, 0.95
#: Most files whose ids are broadcast to fetch their texts for the exact check; more are joined by a shuffle.
MAX_LOCAL_IDS = 200_000
#: Known signatures of a bucket that one join key takes; larger buckets are split over several, which changes the spread of work only.
BUCKET_PART = 500
_TOKEN = re.compile(r"\w+")
_SEEDS = np.random.default_rng(1).integers(1, 2**63, (2, HASHES), np.uint64) | np.uint64(1)


@lru_cache(200_000)
def _number(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def shingles(text: str) -> np.ndarray | None:
    """Hashes of a text's distinct five-word shingles, sorted; None for texts of fewer words."""
    words = _TOKEN.findall(text)
    n = len(words) - WORDS + 1
    if n < 1:
        return None
    w = np.fromiter(map(_number, words), np.uint64, len(words))
    h = w[:n].copy()
    for k in range(1, WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(text: str) -> np.ndarray | None:
    """MinHash of a text's shingles."""
    h = shingles(text)
    if h is None:
        return None
    out = np.empty(HASHES, np.uint64)
    for k in range(HASHES):
        out[k] = ((h * _SEEDS[0, k]) ^ (h >> np.uint64(31)) * _SEEDS[1, k]).min()
    return (out >> np.uint64(32)).astype(np.int64)


def _signed(files: DataFrame) -> DataFrame:
    """(file_id, kind, known, sig): the kind by layout and marks, whether marks say vendored, and the signature of those and of files of no kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, known, sigs = [], [], []
            for lang, path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text = text.as_py()
                k, _, by_mark = judged(lang, path, text)
                s = signature(text) if text and lang is not None and (k is None or by_mark == "vendored") else None
                kinds.append(k)
                known.append(by_mark == "vendored")
                sigs.append(None if s is None else s.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(known, pa.bool_()), pa.array(sigs, pa.list_(pa.int64()))], names=["file_id", "kind", "known", "sig"])

    return files.select("file_id", "language_id", "file_path", "content").mapInArrow(run, "file_id long, kind string, known boolean, sig array<long>")


def _banded(sigs: DataFrame) -> DataFrame:
    """(sig, band, bucket) of each distinct signature."""
    rows = HASHES // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))
    return sigs.select("sig").distinct().select("sig", F.posexplode(bands).alias("band", "bucket"))


def found(files: DataFrame) -> DataFrame:
    """``(file_id, kind)`` of the files that aren't hand-written, unmarked copies of vendored ones among them; an id comes once."""
    signed = cut(_signed(files))
    known = _banded(signed.filter("known AND sig IS NOT NULL")).withColumnRenamed("sig", "other")
    free = _banded(signed.filter("kind IS NULL AND sig IS NOT NULL"))
    parts = known.groupBy("band", "bucket").agg(F.ceil(F.count("*") / BUCKET_PART).cast("int").alias("parts"))
    known = known.join(parts, ["band", "bucket"]).select("band", "bucket", F.pmod(F.hash("other"), "parts").alias("part"), "other")
    free = free.join(parts, ["band", "bucket"]).select("band", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sig")
    same = F.aggregate(F.zip_with("sig", "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + x)
    pairs = cut(free.join(known, ["band", "bucket", "part"]).withColumn("same", same).filter(F.col("same") >= CANDIDATE * HASHES).select("sig", "other", "same").distinct())
    sure = pairs.filter(F.col("same") >= SURE * HASHES).select("sig").distinct()
    alike = sure.unionByName(_checked(files, signed, pairs.join(sure, "sig", "left_anti")))
    near = signed.filter("kind IS NULL").join(alike, "sig", "left_semi").select("file_id", F.lit("vendored").alias("kind"))
    return signed.filter("kind IS NOT NULL").select("file_id", "kind").union(near).groupBy("file_id").agg(F.min("kind").alias("kind"))


def _checked(files: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The signatures of pairs (sig, other) whose texts are similar by their exact shingle sets; one file stands for each signature."""
    free = signed.filter("kind IS NULL AND sig IS NOT NULL").groupBy("sig").agg(F.min("file_id").alias("a"))
    known = signed.filter("known AND sig IS NOT NULL").groupBy(F.col("sig").alias("other")).agg(F.min("file_id").alias("b"))
    doubtful = cut(pairs.select("sig", "other").join(free, "sig").join(known, "other").select("sig", "a", "b"))
    ids = doubtful.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
    few = ids.count() <= MAX_LOCAL_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if h is None else h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["file_id", "set"])

    texts = files.select("file_id", "content").join(F.broadcast(ids) if few else ids, "file_id", "left_semi").dropDuplicates(["file_id"])
    sets = texts.mapInArrow(run, "file_id long, set array<long>").filter("set IS NOT NULL")
    both = doubtful.join(sets.withColumnsRenamed({"file_id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"file_id": "b", "set": "y"}), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) >= SIMILAR * F.size(F.array_union("x", "y"))).select("sig").distinct()
