"""Problem 1: long exact spans shared between records.

Method: level-wise doubling. With the least length L, windows of k = ceil(L/2)
characters are hashed by doubling (hashes of 1, 2, 4 ... characters combine to
those of k and then of L). Level one keeps one window of length k for each
stretch of window starts: the one of least hash among the L - k + 1 that lie in
the same window of length L. Windows that lie in equal text choose equally, so a
shared run of length L always shares its chosen window. Only windows of length k
found in two records are extended to twice the length; of those, stretches whose
whole context agrees are settled at once, and only the rest (edges of shared
runs) are compared window by window at length L. A longer level can't change
which characters are shared, so for those none are carried on; ``levels`` doubles
further, on the records that still hold candidates, until none survive, and tells
the greatest level that each record shares.

Texts are compared by 64-bit hashes of both halves of a window, so that a false
match needs one half that truly agrees and a collision in the other: with c pairs
of records that agree in one half only, c / 2 ** 64 are expected.

Scale: level one moves one row of hashes for each ~(L - k + 2) / 2 characters,
never texts; groups of copies are pre-aggregated to (least, greatest) record
before the shuffle, and the join back is split by AQE where a group is hot.
Texts travel again only for records that own an undecided edge. Their ids are
broadcast behind a check of their number; above it they are joined by a shuffle.

Defined results: null ids and texts, and texts shorter than L, share nothing;
repeated rows of an id are one record; a repeat inside one record doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.tables import cut, spread

MIN_LENGTH = 150
#: Most record ids broadcast to find the texts that are needed again (8 bytes each).
MAX_LOCAL_IDS = 200_000
#: Characters hashed at a time; keeps the arrays in the processor's cache.
CHUNK = 1 << 17

_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _A
    h += right
    h ^= h >> _S
    h *= _B
    return h


def window_hashes(chars: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of all windows of ``length`` characters, by doubling."""
    h = (chars.astype(np.uint64) + np.uint64(seed + 1)) * _B
    h ^= h >> _S
    n = 1
    while 2 * n <= length:
        h = _join(h[:-n], h[n:])
        n *= 2
    if n < length:
        h = _join(h[: n - length], h[length - n :])
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    if n < width:
        h = np.minimum(h[: n - width], h[width - n :])
    return h


def _final(h: np.ndarray, length: int, k: int) -> np.ndarray:
    """Hashes of length ``length`` from those of length k (k <= length <= 2k)."""
    return h if length == k else _join(h[: k - length], h[length - k :])


def stretches(texts: list[str], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Level one of several texts: owner, first window start, number of starts, chosen hash, context hash."""
    k = (length + 1) // 2
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = window_hashes(chars, k, seed)
    chosen, whole = _least(h, length - k + 1), _final(h, length, k)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    at = np.arange(len(chosen)) - begin[owner]
    inside = at + length <= sizes[owner]
    chosen, whole, owner, at = chosen[inside], whole[inside], owner[inside], at[inside]
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(chosen)])))
    offset = (np.arange(len(chosen)) - np.repeat(first, count)).astype(np.uint64)
    mixed = (whole ^ (whole >> _S)) * (offset * _A + _B)
    return owner[first], at[first], count, chosen[first], np.add.reduceat(mixed, first)


def _level_one(texts: DataFrame, length: int) -> DataFrame:
    """texts: (field int, rec long, text string) -> one row for each stretch of window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, recs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            part: list[tuple[int, str]] = []
            held = 0
            for k in range(batch.num_rows):
                part.append((k, batch.column(2)[k].as_py()))
                held += len(part[-1][1])
                if held >= CHUNK or k + 1 == batch.num_rows or fields[k + 1] != fields[k]:
                    own, at, n, m, c = stretches([t for _, t in part], length, fields[k])
                    ids = np.fromiter((recs[j] for j, _ in part), np.int64, len(part))[own]
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(own), fields[k], np.int32))], names=["m", "c", "rec", "at", "n", "field"])
                    part, held = [], 0

    return texts.mapInArrow(run, "m long, c long, rec long, at int, n int, field int")


def _edge_windows(reps: DataFrame, length: int) -> DataFrame:
    """reps with text: the hashes of length ``length`` of each undecided stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, field, todo in zip(batch.column("text"), batch.column("field").to_pylist(), batch.column("todo").to_pylist(), strict=True):
                text = text.as_py()
                chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                k = (length + 1) // 2
                for x in todo:
                    h = _final(window_hashes(chars[x["at"] : x["at"] + x["n"] + length - 1], k, field), length, k)
                    out.append((x["m"], x["c"], x["r1"], x["r2"], h.view(np.int64)))
                if len(out) > 2000:
                    yield _edges(out)
                    out = []
            if out:
                yield _edges(out)

    return reps.mapInArrow(run, "m long, c long, r1 long, r2 long, hs array<long>")


def _edges(out: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x[4]) for x in out]))).astype(np.int32))
    return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[4] for x in out])))], names=["m", "c", "r1", "r2", "hs"])


def _united(spans: DataFrame) -> DataFrame:
    """(field, rec, from_pos, to_pos) with overlapping and touching spans made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for field, rec, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                parts = sorted((p["from_pos"], p["to_pos"]) for p in parts)
                lo, hi = parts[0]
                for a, b in parts[1:]:
                    if a <= hi:
                        hi = max(hi, b)
                    else:
                        out.append((field, rec, lo, hi))
                        lo, hi = a, b
                out.append((field, rec, lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["field", "rec", "from_pos", "to_pos"])

    grouped = spans.groupBy("field", "rec").agg(F.collect_set(F.struct("from_pos", "to_pos")).alias("parts"))
    return grouped.mapInArrow(run, "field int, rec long, from_pos int, to_pos int")


def shared_spans(texts: DataFrame, min_length: int = MIN_LENGTH, max_local_ids: int = MAX_LOCAL_IDS) -> DataFrame:
    """``(field, rec, from_pos, to_pos)``: the maximal runs of characters that lie in
    spans of at least ``min_length`` found verbatim in another record of the field.

    texts: ``(field int, rec long, text string)``; fields are compared apart.
    """
    texts = texts.select("field", "rec", "text").filter(F.col("field").isNotNull() & F.col("rec").isNotNull() & (F.length("text") >= min_length))
    rows = _level_one(spread(texts), min_length)
    repeated = rows.groupBy("m").agg(F.min("rec").alias("r1"), F.max("rec").alias("r2")).filter("r1 <> r2").select("m")
    kept = cut(rows.join(repeated, "m", "left_semi"))
    # A context found in two records is shared as a whole; "rep" stands for all its rows.
    classes = cut(
        kept.groupBy("m", "c").agg(F.min("rec").alias("r1"), F.max("rec").alias("r2"), F.min(F.struct("field", "rec", "at", "n")).alias("rep"))
    )
    whole = kept.join(classes.filter("r1 <> r2").select("m", "c"), ["m", "c"], "left_semi").select("field", "rec", F.col("at").alias("from_pos"), (F.col("at") + F.col("n") + (min_length - 1)).alias("to_pos"))
    open_m = classes.groupBy("m").agg(F.count("*").alias("k"), F.max(F.col("r1") == F.col("r2")).alias("open")).filter("k > 1 AND open").select("m")
    reps = classes.join(open_m, "m", "left_semi").select("m", "c", "r1", "r2", "rep.*")
    todo = cut(reps.groupBy("field", "rec").agg(F.collect_list(F.struct("m", "c", "r1", "r2", "at", "n")).alias("todo")))
    again = texts
    if todo.count() <= max_local_ids:
        again = again.join(F.broadcast(todo.select("field", "rec")), ["field", "rec"], "left_semi")
    again = again.dropDuplicates(["field", "rec"])
    edges = _edge_windows(again.join(todo, ["field", "rec"]), min_length).select("m", "c", "r1", "r2", F.posexplode("hs").alias("d", "h"))
    edges = cut(edges)
    same = edges.groupBy("m", "h").agg(F.min("r1").alias("a"), F.max("r2").alias("b")).filter("a <> b").select("m", "h")
    partly = edges.filter("r1 = r2").join(same, ["m", "h"], "left_semi").groupBy("m", "c").agg(F.sort_array(F.collect_set("d")).alias("ds"))
    part = (
        kept.join(partly, ["m", "c"])
        .select("field", "rec", "at", F.explode("ds").alias("d"))
        .select("field", "rec", (F.col("at") + F.col("d")).alias("from_pos"), (F.col("at") + F.col("d") + min_length).alias("to_pos"))
    )
    return _united(whole.unionByName(part))


def levels(texts: DataFrame, min_length: int = MIN_LENGTH, spans: DataFrame | None = None) -> DataFrame:
    """``(field, rec, level)``: the greatest min_length * 2 ** k for which the record holds a span of that length that another record of the field holds too.

    Level by level: records whose shared runs are at least twice the level long are
    candidates of the next one, and only their texts are read again; the doubling
    ends where no candidates survive. Records that share nothing have no row.
    """
    me = ["field", "rec"]
    found = shared_spans(texts, min_length) if spans is None else spans
    length, out = min_length, None
    while True:
        runs = cut(found.groupBy(*me).agg(F.max(F.col("to_pos") - F.col("from_pos")).alias("run")))
        step = runs.select(*me, F.lit(length).alias("level"))
        out = step if out is None else out.unionByName(step)
        length *= 2
        alive = runs.filter(F.col("run") >= length).select(*me)
        if alive.isEmpty():
            return out.groupBy(*me).agg(F.max("level").alias("level"))
        found = shared_spans(texts.join(alive, me, "left_semi"), length)


def shared_share(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """For each record its length, the shared characters and their share (0 where none)."""
    own = texts.groupBy("field", "rec").agg(F.max(F.length("text")).alias("chars"))
    total = spans.groupBy("field", "rec").agg(F.sum(F.col("to_pos") - F.col("from_pos")).alias("shared"), F.count("*").alias("runs"), F.max(F.col("to_pos") - F.col("from_pos")).alias("longest"))
    return own.join(total, ["field", "rec"], "left").select("field", "rec", "chars", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("longest", F.lit(0)).alias("longest"), F.round(F.coalesce(F.col("shared") / F.col("chars"), F.lit(0.0)), 6).alias("share"))
