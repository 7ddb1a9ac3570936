"""Fingerprints by locally consistent parsing.

A text's bytes are cut into phrases by rules that look at a few neighbours only: runs of equal
symbols become one symbol, deterministic coin tossing (three rounds: twice the place of the lowest
bit in which a symbol differs from the one before it, plus that bit) leaves labels below eight, and
a phrase starts where a label is greater than both beside it.  A phrase's name is a hash of its
symbols, and the names are cut again, level by level, until one is left.  So equal passages have
equal phrases at each level wherever they stand, but for some at their ends.

A fingerprint has the root's name and sketches of two levels' sets of names: least names of 64
bins, a byte of each.  Work on a text is numpy over its bytes; a level has at most half the symbols
of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import small_batches, small_table

from .scratch import materialise
from .words import mix

#: Bins of a sketch; the highest level that is sketched (phrases of some 20 bytes); a lower level is
#: taken where a text has fewer phrases than that.
BINS, LEVEL, PHRASES = 64, 3, 32
#: Bytes of text that are parsed at once (a longer text goes alone).
SLICE_BYTES = 1 << 18
_rng = np.random.default_rng(77)
_PLACE, _RUN, _SIZE, _VALUE = (int(x) | 1 for x in _rng.integers(1, 2**62, 4))
_LOW = np.array([0] + [(v & -v).bit_length() - 1 for v in range(1, 256)], np.uint8)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A round of coin tossing; neighbours differ before and after it.  first: starts of texts."""
    differ = np.empty_like(label)
    differ[1:] = label[1:] ^ label[:-1]
    differ[first] = 1  # a text's first symbol has its lowest bit
    if label.dtype == np.uint8:
        place = _LOW[differ]
        return place * np.uint8(2) + ((label >> place) & np.uint8(1))
    place = _LOW[(differ & np.uint64(255)).astype(np.uint8)]
    for k in np.flatnonzero((differ & np.uint64(255)) == 0).tolist():  # one of 256
        d = int(differ[k])
        place[k] = (d & -d).bit_length() - 1
    return place * np.uint8(2) + ((label >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def _runs_joined(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols of a row as one symbol each; and the rows of what is left."""
    stays = np.ones(len(x), bool)
    stays[1:] = (x[1:] != x[:-1]) | (rows[1:] != rows[:-1])
    if stays.all():
        return x, rows
    at = np.flatnonzero(stays)
    length = np.diff(np.append(at, len(x)))
    x, rows = x[at], rows[at]
    long = length > 1
    x[long] = mix(x[long] + length[long].astype(np.uint64) * np.uint64(_RUN))
    return x, rows


def _phrases(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of symbols x, of which no two beside each other are equal, and their rows."""
    first = np.ones(len(x), bool)
    first[1:] = rows[1:] != rows[:-1]
    label = x
    for _ in range(3):
        label = _toss(label, first)
    start = first.copy()
    inner = label[1:-1]
    start[1:-1] |= (inner > label[:-2]) & (inner > label[2:]) & ~first[2:]
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(x)))
    place = np.arange(len(x)) - np.repeat(at, size)
    name = np.add.reduceat(mix(x + place.astype(np.uint64) * np.uint64(_PLACE)), at)
    return mix(name + size.astype(np.uint64) * np.uint64(_SIZE)), rows[at]


def _levels(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, rows, counts by row) of each level from 1; a row is gone above the level that has its root."""
    x = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    while len(x):
        x, rows = _phrases(*_runs_joined(x, rows))
        count = np.bincount(rows, minlength=len(texts))
        yield x, rows, count
        more = count[rows] > 1
        x, rows = x[more], rows[more]


class Parsed:
    """Fingerprints of several texts: root (uint64), level and sketches (texts x 2 x BINS bytes)."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        self.root, self.level = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.sketch = np.zeros((n, 2, BINS), np.uint8)
        for level, (names, rows, count) in enumerate(_levels(texts), 1):
            alone = count[rows] == 1
            self.root[rows[alone]] = names[alone]
            if level <= LEVEL:
                here = (count >= PHRASES) if level > 1 else count > 0
                self.sketch[here, 1] = self.sketch[here, 0]
                self.sketch[here, 0] = _sketch(names, rows, n)[here]
                self.level[here] = level

    def __len__(self) -> int:
        return len(self.root)

    def strings(self) -> list[str]:
        return [f"{int(r):016x}-{lv}-{s.tobytes().hex()}" for r, lv, s in zip(self.root, self.level.tolist(), self.sketch, strict=True)]

    def taken(self, rows: np.ndarray) -> Parsed:
        out = object.__new__(Parsed)
        out.root, out.level, out.sketch = self.root[rows], self.level[rows], self.sketch[rows]
        return out


def _sketch(names: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Of each row and bin a byte (1 to 255) of the least name, 0 where no name falls into it."""
    none = np.uint64(2**64 - 1)
    least = np.full(n * BINS, none)
    np.minimum.at(least, rows * BINS + (names % np.uint64(BINS)).astype(np.int64), names // np.uint64(BINS))
    value = ((least * np.uint64(_VALUE)) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return np.where(least == none, np.uint64(0), value).astype(np.uint8).reshape(n, BINS)


def likeness(a: Parsed, b: Parsed) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: the share of common phrases at the highest level that both
    have a sketch of, as the sketches let it be estimated; 1 for equal texts, 0 where no level is common
    (one text is several times as long as the other, or empty)."""
    by = a.level - b.level
    each = np.arange(len(a))
    x, y = a.sketch[each, np.clip(by, 0, 1)], b.sketch[each, np.clip(-by, 0, 1)]
    used = ((x > 0) | (y > 0)).sum(1)
    share = ((x == y) & (x > 0)).sum(1) / np.maximum(used, 1)
    by_chance = 1 / 255
    out = np.clip((share - by_chance) / (1 - by_chance), 0, 1)
    out[(np.abs(by) > 1) | (np.minimum(a.level, b.level) == 0)] = 0
    out[(a.root == b.root) & (a.level == b.level)] = 1
    return np.round(out, 6)


def parsed(strings: list[str]) -> Parsed:
    """Fingerprints read back from their strings."""
    out = object.__new__(Parsed)
    split = [s.split("-") for s in strings]
    out.root = np.array([int(r, 16) for r, _, _ in split], np.uint64)
    out.level = np.array([int(lv) for _, lv, _ in split], np.int64)
    out.sketch = np.frombuffer(bytes.fromhex("".join(s for _, _, s in split)), np.uint8).reshape(len(split), 2, BINS)
    return out


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(sizes):
        end, size = row + 1, sizes[row]
        while end < len(sizes) and size + sizes[end] <= SLICE_BYTES:
            size += sizes[end]
            end += 1
        yield row, end
        row = end


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of docs (doc_id, text); null is as empty, other columns are left out.

    The fingerprint of an empty text has the root 0 and the level 0."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            out = [s for a, b in _slices([len(t) for t in texts]) for s in Parsed(texts[a:b]).strings()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as much of the beginning of following."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(texts: list[str], following: list[str]) -> dict[str, pa.Array]:
    """The columns of _RESULT for texts and those that follow them."""
    out: dict[str, list] = {c.split()[0]: [] for c in _RESULT.split(", ")}
    for a, b in _slices([2 * len(t) + len(n) for t, n in zip(texts, following, strict=True)]):
        part, after = texts[a:b], following[a:b]
        new = [edited(t, n).encode() for t, n in zip(part, after, strict=True)]
        # a text that follows is mostly the next text itself
        own = [t.encode() for t in part]
        again = [k + 1 < len(part) and part[k + 1] is n for k, n in enumerate(after)]
        more = [n.encode() for n, seen in zip(after, again, strict=True) if not seen]
        all_ = Parsed(own + more + new)
        place, nexts = len(part), []
        for k, seen in enumerate(again):
            nexts.append(k + 1 if seen else place)
            place += not seen
        mine = all_.taken(np.arange(len(part)))
        theirs, changed = all_.taken(np.array(nexts)), all_.taken(np.arange(place, place + len(part)))
        out["n_chars"] += [len(t) for t in part]
        out["edited_sha256"] += [hashlib.sha256(t).hexdigest() for t in new]
        out["fingerprint"] += mine.strings()
        out["edited_fingerprint"] += changed.strings()
        out["near_edited"] += likeness(mine, changed).tolist()
        out["near_next"] += likeness(mine, theirs).tolist()
    return {c: pa.array(out[c], t) for c, t in zip(out, (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)}


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of _RESULT for each row of docs (doc_id, text): its text, and the text
    edited by the next row in descending order of doc_id; after the last comes the first.

    Rows of equal doc_id go by a hash of the text; null ids come last, null texts are empty; one row
    is its own next, an empty table gives no rows; other columns are left out.  Rows are dealt by ranges of
    the order and sorted there, so that a task sees each row beside its next.  What a range ends with
    is compared with what the following one begins with afterwards: a row or two for each range."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    order = [F.desc_nulls_last("doc_id"), F.asc("_h"), F.asc("_row")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # rows equal in both are the same to all that follows: _row lets ranges cut through them
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ids = TaskContext.get().partitionId(), None, None

        def out(ids: pa.Array, columns: dict[str, pa.Array], edge: str | None, text: str | None) -> pa.RecordBatch:
            n = len(ids)
            more = {"part": pa.array([part] * n, pa.int32()), "edge": pa.array([edge] * n, pa.string()), "text": pa.array([text] * n, pa.string())}
            return pa.record_batch({"doc_id": ids, **columns, **more})

        def ends(ids: pa.Array, edge: str, text: str) -> pa.RecordBatch:
            none = {c: v[:0] for c, v in _compared([], []).items()}
            return out(ids, {c: pa.nulls(1, v.type) for c, v in none.items()}, edge, text)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, new = batch.column("text").to_pylist(), batch.column("doc_id")
            if held is None:
                yield ends(new[:1], "first", texts[0])
                ids = new
            else:
                texts, ids = [held, *texts], pa.concat_arrays([ids, new])
            if len(texts) > 1:
                yield out(ids[:-1], _compared(texts[:-1], texts[1:]), None, None)
            held, ids = texts[-1], ids[-1:]
        if held is not None:
            yield ends(ids, "last", held)

    found = materialise(rows.mapInArrow(task, f"doc_id {kind}, {_RESULT}, part int, edge string, text string"), "compared")
    parts = sorted(r["part"] for r in found.where("edge = 'first'").select("part").collect())  # one for each range
    after = small_table(docs.sparkSession, [{"part": p, "next": q} for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next int")
    first = found.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = found.where("edge = 'last'").select("doc_id", "part", "text")
    pairs = last.join(F.broadcast(after), "part").join(first, "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _compared(batch.column("text").to_pylist(), batch.column("following").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **columns})

    names = ["doc_id", *(c.split()[0] for c in _RESULT.split(", "))]
    return found.where("edge IS NULL").select(*names).unionByName(pairs.mapInArrow(close, f"doc_id {kind}, {_RESULT}"))
