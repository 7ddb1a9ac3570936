"""Sum-of-squares packing of token sequences into windows of fixed length.

Each task packs its own partition online: whole windows are cut from a long document, and its
rest goes to the fill level that makes the sum of squared counts of partially filled windows least
(a new window counts as level 0).  The counts stand in an array by level.  At the end of a
partition, what is left in partial windows is cut again into whole windows and, for the last of
them, windows of powers of two, so that nothing is padded.

A partition read from files is the same at each attempt, and so are its windows: a lost executor's
task gives the same rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .scratch import small_batches
from .tokens import encoder

WINDOW = 1024
#: Id that ends each document.
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class LevelPacker:
    """Packs pieces (doc_id, start, doc_tokens, ids); rows() gives the placed ones and forgets them."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, tokens, ids in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        tokens, whole = len(ids), len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self._close([(doc_id, at, tokens, ids[at : at + self.window])])
        if whole < tokens:
            self._place((doc_id, whole, tokens, ids[whole:].copy()))

    def _place(self, piece: tuple) -> None:
        size = len(piece[3])
        n = self.count
        # change of the sum of squares by going from level h to h + size
        change = 2 * (n[size : self.window + 1] - n[: self.window + 1 - size]) + 2
        change[-1] = 1 - 2 * n[self.window - size]
        change[0] = 2 * n[size] + 1
        empty = n[: self.window + 1 - size] == 0
        empty[0] = False
        change[empty] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        held = self.open[level].pop() if level else []
        if level:
            n[level] -= 1
        held.append(piece)
        if level + size == self.window:
            self._close(held)
        else:
            n[level + size] += 1
            self.open[level + size].append(held)

    def finish(self) -> None:
        rest = [piece for level in reversed(self.open) for held in level for piece in held]
        left = sum(len(p[3]) for p in rest)
        held, room = [], 0

        def size_of(left: int) -> int:
            return self.window if left >= self.window else 1 << (left.bit_length() - 1)

        size = size_of(left) if left else 0
        for doc_id, start, tokens, ids in rest:
            at = 0
            while at < len(ids):
                take = min(size - room, len(ids) - at)
                held.append((doc_id, start + at, tokens, ids[at : at + take]))
                room, at = room + take, at + take
                if room == size:
                    self._close(held)
                    left -= size
                    held, room, size = [], 0, size_of(left) if left else 0

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) if self.out else [()] * len(_NAMES)
        self.out = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=_NAMES)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """A row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Null text is empty: one piece with the end id alone.  Each row of docs is a document, also if
    it repeats a doc_id or has none; very long texts are whole; other columns are ignored; an empty
    table gives no rows.  sequence_id holds the partition's number above 2 ** 40.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = LevelPacker(window, TaskContext.get().partitionId() << 40)
        encode = encoder(vocabulary)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, last, flat, at in encode.ids(batch.column("text")):
                for k in range(last - first):
                    packer.add(names[first + k], np.append(flat[at[k] : at[k + 1]], np.uint32(END_ID)))
                yield packer.rows()
        packer.finish()
        yield packer.rows()

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(task, SCHEMA)
