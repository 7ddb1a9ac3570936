"""Runs: stretches of words that repeat with a period, by maximal pairs.

A run of period q from word s over n words is the maximal pair (s, s + q): two occurrences of n - q
words that no equal word extends on either side.  Maximal pairs are read off the tree of
LCP intervals of a document's suffixes, from the bottom: an interval of depth L holds the places of
a repeated sequence of L words, and two of them from different child intervals, with different words to
the left, are a maximal pair.  Runs of three periods are those at most L / 2 apart.

Places so near each other form a chain of equal steps (both distances are periods of the
sequence), whose inner places have one and the same word to the left and to the right.  So in the
list of an interval's places, kept in order beside their left words, a new place can pair with the
first or with the last of those within L / 2 only: two binary searches, whatever the chain's length.

Only sequences of LEAST words or more can give runs, so a document without such a repeated sequence
has no tree to build.  All of it is work within one document; documents are independent.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import small_batches

from .words import mix

#: Least length of a run in words, and least number of its periods.
LENGTH, PERIODS = 24, 3
#: A run's pair is of at least max(LENGTH - q, 2 q) words: 16, whatever q is.
LEAST = LENGTH - LENGTH // PERIODS
#: Words of documents whose suffixes are sorted together (a longer document goes alone).
TOGETHER = 1 << 17
WHITE = r"[\x20\x09-\x0D]+"
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(13).integers(1, 2**62, 8)]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column, and the first word of each row (n + 1 entries)."""
    split = pc.split_pattern_regex(column.fill_null("").cast(pa.large_string()), WHITE)
    offsets = split.offsets.to_numpy()
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offsets - offsets[0]]


def _repeating(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows in which some LEAST words in sequence may stand twice (by hashes: none is missed)."""
    h, width = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    for k in range(4):
        h = mix(h[: len(h) - width] + h[width:] * _ODD[k]) if len(h) > width else h[:0]
        width *= 2
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(h)]
    inside = np.arange(len(h)) + LEAST <= at[1:][row]
    row, h = row[inside], h[inside]
    h = h ^ mix(row.astype(np.uint64) * _ODD[5])
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return np.unique(row[twice[near] == h])


def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks, by doubling."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1]
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1:
            return order, rank


def _common(text: list, order: list, rank: list) -> list:
    """Length of the common prefix of each suffix and the one before it in order (Kasai's way)."""
    out, h = [0] * len(text), 0
    for i, r in enumerate(rank):
        if r:
            j = order[r - 1]
            while text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def _pairs(text: list, order: list, common: list) -> dict[tuple[int, int], int]:
    """(start, length) of each run: its least period.  text ends each document with a word of its own."""
    found: dict[tuple[int, int], int] = {}

    def joined(places: list[int], more: list[int], depth: int) -> list[int]:
        """Two children's places in order; maximal pairs between them are noted."""
        if len(places) < len(more):
            places, more = more, places
        half = depth // 2
        for x in more:
            left = text[x - 1]
            k = bisect_left(places, x - half)
            if k < len(places) and places[k] < x and text[places[k] - 1] != left:
                y = places[k]
                note(y, x - y, depth)
            k = bisect_right(places, x + half) - 1
            if k >= 0 and places[k] > x and text[places[k] - 1] != left:
                note(x, places[k] - x, depth)
        if places[-1] < more[0]:
            places.extend(more)
        else:
            places.extend(more)
            places.sort()  # two ascending stretches: one merge
        return places

    def note(start: int, period: int, depth: int) -> None:
        if depth + period >= LENGTH:
            key = (start, depth + period)
            found[key] = min(period, found.get(key, period))

    depths: list[int] = []
    held: list[list[int]] = []
    current: list[int] = []
    for r, depth in enumerate(common):
        # what came before closes where less than this depth is common
        while depths and depths[-1] > depth:
            current = joined(held.pop(), current, depths.pop())
        if depth < LEAST:
            current = [order[r]]
            continue
        if depths and depths[-1] == depth:
            held[-1] = joined(held[-1], current, depth)
        else:
            depths.append(depth)
            held.append(current)
        current = [order[r]]
    while depths:
        current = joined(held.pop(), current, depths.pop())
    return found


def _runs(ids: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of the rows that have any, by start and period."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rows = _repeating(ids, at).tolist()
    while rows:
        some, size = [rows.pop()], 0
        size = at[some[0] + 1] - at[some[0]]
        while rows and size + at[rows[-1] + 1] - at[rows[-1]] <= TOGETHER:
            some.append(rows.pop())
            size += at[some[-1] + 1] - at[some[-1]]
        parts, starts, n = [], [], 0
        span = int(ids.max()) + 2
        for k, row in enumerate(some):
            # words are told apart by document too, and a word of its own ends each
            parts.append(np.append(ids[at[row] : at[row + 1]], span - 1) + k * span)
            starts.append(n)
            n += len(parts[-1])
        text = np.concatenate(parts)
        order, rank = _suffixes(text)
        words, suffixes = text.tolist(), order.tolist()
        for (start, length), period in _pairs(words, suffixes, _common(words, suffixes, rank.tolist())).items():
            k = bisect_right(starts, start) - 1
            out.setdefault(some[k], []).append((start - starts[k], length, period))
    for found in out.values():
        found.sort(key=lambda x: (x[0], x[2]))
    return out


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed for each row of docs (doc_id, text).

    runs: stretches of words with smallest period q and at least max(LENGTH, PERIODS * q) words that no
    word beside them extends, in order of start and period.  collapsed: the words joined by one
    blank, without those that stand in a run after its first q.  Null and empty texts have no words, no runs and
    an empty collapsed text; each row is a document, also one that repeats a doc_id or has none;
    other columns are left out; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _words(batch.column("text"))
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
            found = _runs(ids, at)
            keep = np.ones(len(words), bool)
            for row, runs in found.items():
                for start, length, period in runs:
                    keep[at[row] + start + period : at[row] + start + length] = False
            left = np.concatenate([[0], np.cumsum(keep)])[at]
            kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep)))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(k, ())] for k in range(batch.num_rows)]
            kinds = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))
            collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "runs": pa.array(runs, kinds), "collapsed": collapsed})

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, of equals the first by start and period; null without runs."""
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, of which about every tenth is made to repeat: with h the CRC-32 of doc_id
    in decimal, h % 10 = 0 and g = floor(h / 10), the words from a = g % n on become the first p of them
    again and again, p = 1 + floor((n - a) / (3 + g % 8)).  A row without a doc_id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    some = some.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(F.col("a").isNotNull(), p))
    tail = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.get(F.col("w"), F.col("a") + i % F.col("p")))
    return some.select("doc_id", F.when(F.col("p").isNotNull(), F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), tail)).otherwise(F.col("text")).alias("text"))
