"""Token ids of a byte-level BPE vocabulary, for whole Arrow batches.

The vocabulary splits text into pieces by a fixed pattern before merging, and merges never cross
pieces.  So each distinct piece is encoded once per task, by the tokenizer itself, and texts are
assembled from the pieces' ids in numpy.  Texts that hold a special token's string are left to the
tokenizer whole.
"""

from __future__ import annotations

import functools
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import mix

#: Characters encoded at once (a longer text goes alone), and pieces remembered by a task.
SLICE_CHARS, REMEMBERED = 1 << 17, 1 << 19
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_classes: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other."""
    global _classes
    if _classes is None:
        import unicodedata

        table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        kinds = "".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1))
        kinds = np.frombuffer(kinds.encode(), "S1")
        table[kinds == b"L"] = _LETTER
        table[kinds == b"N"] = _NUMBER
        table[kinds == b"Z"] = _SPACE
        table[[*range(9, 14), 0x85]] = _SPACE
        _classes = table
    return _classes


def _pieces(cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a slice of code points whose rows start at rows[:-1]."""
    n = len(cp)
    kind = _char_classes()[np.minimum(cp, sys.maxunicode)]
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    start = row_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last_space = np.zeros(n, bool)  # white space before something else in the same row
    last_space[:-1] = space[:-1] & ~space[1:] & ~row_start[1:n]
    start |= last_space
    led = np.zeros(n, bool)  # preceded by its blank
    led[1:] = last_space[:-1] & (cp[:-1] == 32)
    start &= ~led
    # 's 't 'm 'd 're 've 'll where a piece begins with the apostrophe alone
    q = np.flatnonzero((cp == 39) & start)
    q = q[(q + 1 < n)]
    q = q[~row_start[q + 1]]
    if len(q):
        one = np.isin(cp[q + 1], np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        has2 = (q + 2 < n) & ~row_start[np.minimum(q + 2, n)]
        pair = cp[q + 1].astype(np.int64) << 21 | cp[np.minimum(q + 2, n - 1)]
        two = has2 & np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
        for hit, width in ((q[one], 2), (q[two & ~one], 3)):
            start[hit + 1] = False
            after = hit + width
            after = after[after < n]
            start[after[(kind[after] == _LETTER)]] = True
    return np.flatnonzero(start)


def _byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary (printable characters stand for bytes) as bytes to id."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}


class _Table:
    """64-bit hashes to entry numbers: open addressing, looked up and filled in whole arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.slots, self.known = np.full(1 << bits, -1, np.int32), np.zeros(0, np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        open_, step = np.arange(len(h)), np.uint64(0)
        while len(open_):
            at = self.slots[((h[open_] + step) & self.mask).astype(np.int64)]
            used = at >= 0
            open_, at = open_[used], at[used]
            hit = self.known[at] == h[open_]
            out[open_[hit]] = at[hit]
            open_, step = open_[~hit], step + np.uint64(1)
        return out

    def add(self, h: np.ndarray) -> None:
        """New distinct hashes get the next entry numbers; the table grows so that half stays free."""
        if 2 * (len(self.known) + len(h)) > len(self.slots):
            h = np.concatenate([self.known, h])
            self.__init__((2 * len(h)).bit_length())
        entry = np.arange(len(self.known), len(self.known) + len(h), dtype=np.int32)
        self.known = np.concatenate([self.known, h])
        open_, step = np.arange(len(h)), np.uint64(0)
        while len(open_):
            at = ((h[open_] + step) & self.mask).astype(np.int64)
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[open_[free]]
            open_, step = open_[self.slots[at] != entry[open_]], step + np.uint64(1)


def _grown(a: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more > len(a):
        a = np.concatenate([a, np.zeros(max(len(a), more), a.dtype)])
    return a


class Encoder:
    """ids(column) yields (first row, last row + 1, flat ids, offsets) for a string column.

    Ids are those of tokenizers.Tokenizer.from_file(path) without added special tokens.
    """

    cuts = staticmethod(_pieces)

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path = path
        # the file itself: the tokenizer made from it takes some 60 MB, and few tasks need it
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.special = [t["content"] for t in found["added_tokens"]]
        ranks = _byte_ranks(found["model"]["vocab"])
        del found
        # pieces are cut below, so that the pattern lets each through whole
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.factor = int(np.random.default_rng(5).integers(1, 2**62)) * 2 + 1
        self.forget()

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, for the few texts that hold its special tokens."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.table = _Table(18)
        self.at, self.length, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(getattr(self, "power", ())) < n:
            size, inverse = max(n, SLICE_CHARS * 5 // 4), pow(self.factor, -1, 2**64)
            p, q = np.full(size, np.uint64(self.factor)), np.full(size, np.uint64(inverse))
            p[0] = q[0] = 1
            self.power, self.inverse = np.cumprod(p), np.cumprod(q)
        return self.power, self.inverse

    def merged(self, texts: list[str]) -> list[list[int]]:
        return [self.merge(t) for t in texts]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        encoded = self.merged(texts)
        length = np.fromiter(map(len, encoded), np.int32, len(encoded))
        n, total = len(self.table.known), int(length.sum())
        self.at, self.length = _grown(self.at, n, len(encoded)), _grown(self.length, n, len(encoded))
        self.flat = _grown(self.flat, self.used, total)
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, total)
        self.length[n : n + len(encoded)] = length
        self.at[n : n + len(encoded)] = self.used + np.cumsum(length) - length
        self.used += total
        self.table.add(hashes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, cut into pieces, and offsets."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = self.cuts(cp, rows)
        ends = np.append(starts[1:], len(cp))
        power, inverse = self._powers(len(cp) + 1)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        if len(self.table.known) > REMEMBERED:
            self.forget()
        at = self.table.find(hashes)
        where = np.flatnonzero(at < 0)
        if len(where):
            fresh, first = np.unique(hashes[where], return_index=True)
            self._learn(fresh, [joined[starts[k] : ends[k]] for k in where[first].tolist()])
            at[where] = self.table.find(hashes[where])
        length = self.length[at].astype(np.int64)
        ends_out = np.cumsum(length)
        begin = ends_out - length
        out = self.flat[np.arange(ends_out[-1]) - np.repeat(begin - self.at[at], length)]
        edges = np.concatenate([[0], ends_out])
        return out, edges[np.searchsorted(starts, rows)]

    def ids(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
        row = 0
        while row < len(sizes):
            end, size = row, 0
            while end < len(sizes) and (end == row or size + sizes[end] <= SLICE_CHARS):
                size += sizes[end]
                end += 1
            part = ["" if t is None else t for t in column.slice(row, end - row).to_pylist()]
            odd = [k for k, t in enumerate(part) if any(s in t for s in self.special)]
            flat, offsets = self.encode(["" if k in odd else t for k, t in enumerate(part)] if odd else part)
            if odd:
                each = np.split(flat, offsets[1:-1])
                for k in odd:
                    each[k] = np.array(self.whole.encode(part[k], add_special_tokens=False).ids, np.uint32)
                flat, offsets = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
            yield row, end, flat, offsets
            row = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file: workers keep it, and its pieces, from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
