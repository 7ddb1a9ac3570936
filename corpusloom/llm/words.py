"""Vectorised words and shingles over Arrow string columns (used inside Spark tasks).

A word is a run of bytes other than space and 0x09-0x0D, after lower-casing A-Z.
UTF-8 continuation bytes are all above 0x7F, so both rules work on bytes.  Hashes are
64-bit: a polynomial hash per word and a mixed linear form of five words per shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into numpy arrays at once (a longer text goes alone).
SLICE_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_ODD[0]) | 1
_P_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash (murmur-style shifts and multiplications)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        both = []
        for base in (_P, _P_INV):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            both.append(np.cumprod(p))
        _powers = (both[0], both[1])
    return _powers


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, row offsets) over a string column; null is empty."""
    column = pa.array([], pa.large_string()) if column is None else column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of a slice, and each row's first word (n + 1 entries)."""
    inside = ~_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    if len(data):
        edge[0] = inside[0]
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[-1] = inside[-1]
        # a word also ends where its row ends
        cuts = rows[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        split = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
        edge[split] = False
        marks = np.flatnonzero(edge)
        starts = np.sort(np.concatenate([marks[inside[np.minimum(marks, len(data) - 1)] & (marks < len(data))], split]))
        ends = np.sort(np.concatenate([marks[(marks == len(data)) | ~inside[np.minimum(marks, len(data) - 1)]], split]))
    else:
        starts = ends = np.zeros(0, np.int64)
    power, inverse = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return starts, ends, hashes, np.searchsorted(starts, rows)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n word hashes."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += hashes[k : k + count] * _ODD[k + 1]
    return mix(out)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; a shorter text is one shingle, an empty one none."""
    for first, last, data, rows in text_slices(column):
        _, _, words, at = words_of(data, rows)
        every = grams(words, n)
        for k in range(last - first):
            a, b = at[k], at[k + 1]
            if b - a >= n:
                s = np.sort(every[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
            elif b > a:
                tail = words[a:b]
                yield mix(np.sum(tail * _ODD[32 : 32 + len(tail)], keepdims=True) + np.uint64(b - a))
            else:
                yield every[:0]


class Repeats:
    """Values that a task holds often: of each HELD values, those that stand there `least` times or
    more, with their counts.  Sums over tasks are estimates from below, which only shape plans."""

    #: Values held before they are counted (8 bytes each, and as much again to count them).
    HELD = 1 << 20

    def __init__(self, least: int):
        self.more, self.held, self.size = least - 1, np.empty(self.HELD, np.uint64), 0

    def add(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(values):
            part, values = values[: self.HELD - self.size], values[self.HELD - self.size :]
            self.held[self.size : self.size + len(part)] = part
            self.size += len(part)
            if self.size == self.HELD:
                yield self.flush()

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """(values, counts); of a run of c equal ones, all but the last `more` have an equal so many places on."""
        s, self.size = self.held[: self.size], 0
        s.sort()
        s = s[: max(0, len(s) - self.more)][s[self.more :] == s[: max(0, len(s) - self.more)]]
        v, c = np.unique(s, return_counts=True)
        return v, c + self.more


def count_repeats(arrays: Iterable[np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, c) of a task's Repeats, and one with h null and the number of all its values."""
    held, total = Repeats(least), 0
    for values in arrays:
        total += len(values)
        for v, c in held.add(values):
            yield pa.record_batch({"h": v.view(np.int64), "c": c.astype(np.int64)})
    v, c = held.flush()
    yield pa.record_batch({"h": pa.array([*v.view(np.int64).tolist(), None], pa.int64()), "c": pa.array([*c.tolist(), total], pa.int64())})
