"""Tokens of two vocabularies over the same bytes, aligned.

Byte-level BPE tokens (A) of a blank and the text, and sentence pieces (B) of the text, cover the
same bytes.  In each slice of an Arrow batch pandas.merge_asof, keyed by document, finds the other
side's token that covers each token's start; both directions together are the overlapping pairs.
Those whose ends are equal are links, and each link closes a group of tokens.

Counts of linked ids over the corpus meet their documents by blocks: a block is the
documents of one Arrow batch, with a dictionary of the id pairs linked in it.  Dictionaries, not
documents, are joined with the counts, so that a pair that stands in all documents has a row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import small_batches

from .scratch import materialise
from .tokens import Encoder

#: An id pair as one number.
_A = 1 << 20
_BLANK = "▁"


class _Bytes:
    """What each id of a vocabulary stands for."""

    def __init__(self, of: list[bytes]):
        self.length = np.array([len(x) for x in of], np.int64)
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        self.names = pa.array([str(k) for k in range(len(of))], pa.large_string())

    def join(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.flat[np.arange(int(length.sum())) + np.repeat(self.at[ids] - (ends - length), length)]


class ByteLevel:
    """A: ids of a blank and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import json

        from .tokens import _byte_ranks

        self.encoder = Encoder(path)
        self.encoder.special = []
        with open(path, encoding="utf-8") as f:
            ranks = _byte_ranks(json.load(f)["model"]["vocab"])
        of = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            of[k] = token
        self.bytes = _Bytes(of)


class SentencePieces(Encoder):
    """B: ids of texts, led by a blank, from those of their pieces (blanks and what follows up to the next).

    No entry of such a vocabulary holds a blank after something else, so that merges stay within these
    pieces, and each distinct one is encoded once.  Texts whose bytes come out otherwise are encoded whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        entries = [self.model.id_to_piece(k) for k in range(n)]
        if any(_BLANK in e.lstrip(_BLANK) for e in entries):
            raise ValueError("the vocabulary merges over blanks")
        self.bytes = _Bytes([bytes([int(e[3:5], 16)]) if self.model.is_byte(k) else e.replace(_BLANK, " ").encode() for k, e in enumerate(entries)])
        self.blank = [self.model.piece_to_id(_BLANK)]
        self.factor = int(np.random.default_rng(6).integers(1, 2**62)) * 2 + 1
        self.forget()

    @staticmethod
    def cuts(cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
        start = cp == 32
        start[1:] &= cp[:-1] != 32
        start[rows[rows < len(cp)]] = True
        return np.flatnonzero(start)

    def merged(self, texts: list[str]) -> list[list[int]]:
        # the model puts a blank in front, but leaves an empty text empty
        return [ids or self.blank for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text[1:]), np.int64)


_held: dict[tuple[str, str], tuple[ByteLevel, SentencePieces]] = {}


def _sides(a: str, b: str) -> tuple[ByteLevel, SentencePieces]:
    """The process's vocabularies: workers keep them from task to task."""
    if (a, b) not in _held:
        _held[a, b] = ByteLevel(a), SentencePieces(b)
    return _held[a, b]


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (a, b) of all pairs that share a byte, by place; starts ascend over all documents."""
    left = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    right = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    over_a = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy(np.int64)
    over_b = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy(np.int64)
    inner = np.flatnonzero(start_a[over_b] < start_b)  # pairs that start together are found from a
    a, b = np.concatenate([np.arange(len(start_a)), over_b[inner]]), np.concatenate([over_a, inner])
    order = np.argsort(np.concatenate([start_a, start_b[inner]]), kind="stable")
    return a[order], b[order]


def _split(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


class _Slice:
    """Aligned tokens of some documents: counts, groups as text, and links by document."""

    def __init__(self, a: ByteLevel, b: SentencePieces, texts: list[str], flat: np.ndarray, offsets: np.ndarray):
        n, whole = len(texts), [t.encode() for t in texts]
        n_a, ids_a = np.diff(offsets), flat.astype(np.int64)
        ids_b, at_b = b.encode(texts)
        n_b, ids_b = np.diff(at_b), ids_b.astype(np.int64)
        if not (_same(a.bytes, ids_a, n_a, whole) and _same(b.bytes, ids_b, n_b, whole)):
            # some document's bytes come out otherwise: each by itself
            each_a, each_b = _split(ids_a, n_a), _split(ids_b, n_b)
            held = lambda v, ids, text: _same(v.bytes, ids, np.array([len(ids)]), [text])
            for k, text in enumerate(whole):
                if text and not held(b, each_b[k], text):
                    each_b[k] = b.whole(texts[k])
                if not (held(a, each_a[k], text) and held(b, each_b[k], text)):
                    each_a[k] = each_b[k] = ids_a[:0]
            n_a, n_b = np.array([len(x) for x in each_a]), np.array([len(x) for x in each_b])
            ids_a, ids_b = np.concatenate(each_a), np.concatenate(each_b)
        self.n_a, self.n_b = n_a, n_b
        doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        # documents cover the same bytes on both sides, so that places can go on from one to the next
        size_a, size_b = a.bytes.length[ids_a], b.bytes.length[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        x, y = overlaps(doc_a, end_a - size_a, doc_b, end_b - size_b)
        self.n_overlaps = np.bincount(doc_a[x], minlength=n)
        linked = end_a[x] == end_b[y]
        x, y = x[linked], y[linked]
        self.doc, self.pair = doc_a[x], ids_a[x] * _A + ids_b[y]
        self.n_links = np.bincount(self.doc, minlength=n)
        self.groups = _grouped(a.bytes.names, b.bytes.names, ids_a, ids_b, x, y, self.n_links)


def _same(vocabulary: _Bytes, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> bool:
    """Whether the tokens of each text are its bytes."""
    run = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])
    edges = run[np.concatenate([[0], np.cumsum(counts)])]
    return np.array_equal(np.diff(edges), [len(t) for t in texts]) and np.array_equal(vocabulary.join(ids), np.frombuffer(b"".join(texts), np.uint8))


def _grouped(names_a: pa.Array, names_b: pa.Array, ids_a: np.ndarray, ids_b: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.Array:
    """a1,a2|b1;a3|b2,b3 of each document: x and y are the last tokens of its n groups."""

    def joined(names: pa.Array, ids: np.ndarray, last: np.ndarray) -> pa.Array:
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int64()), names.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(",", pa.large_string()))

    each = pc.binary_join_element_wise(joined(names_a, ids_a, x), joined(names_b, ids_b, y), pa.scalar("|", pa.large_string()))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64()), each)
    return pc.binary_join(lists, pa.scalar(";", pa.large_string()))


_COLUMNS = (
    "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups string, block long, codes array<int>, times array<int>, pairs array<long>, pair_times array<long>"
)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, the numbers of tokens, groups, links and
    overlapping pairs, the groups as text (a1,a2|b1;a3|b2,b3), and its links by block.

    codes and times: the document's linked id pairs, by their place in its block's dictionary, and how
    often it has them.  pairs (see id_pair) and pair_times: that dictionary, with the block's sums; on one row of a block
    alone.  Null and empty texts, and those whose tokens' bytes are not a blank and the text, have no
    tokens.  Rows are documents, also with repeated or null ids; other columns are left out.

    To be materialised before blocks are joined: a block is what one task happened to read together."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(path_a, path_b)
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            texts, done = [f" {t}" if t else "" for t in batch.column("text").to_pylist()], []
            for first, last, flat, offsets in a.encoder.ids(pa.array(texts, pa.large_string())):
                done.append((first, _Slice(a, b, texts[first:last], flat, offsets)))
            if not done:
                continue
            slices = [s for _, s in done]
            put = lambda what: np.concatenate([getattr(s, what) for s in slices])
            doc = np.concatenate([s.doc + first for first, s in done])
            pairs, code, times = np.unique(put("pair"), return_inverse=True, return_counts=True)
            size = max(1, len(pairs))
            each, count = np.unique(doc * size + code, return_counts=True)
            offsets = pa.array(np.searchsorted(each, np.arange(len(texts) + 1) * size), pa.int32())
            n = len(texts)
            once = lambda v: pa.array([v.astype(np.int64), *[None] * (n - 1)], pa.list_(pa.int64()))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_a": put("n_a"), "n_b": put("n_b"), "n_groups": put("n_links"), "n_links": put("n_links"), "n_overlaps": put("n_overlaps"),
                "groups": pa.concat_arrays([s.groups for s in slices]).cast(pa.string()), "block": np.full(n, part << 32 | number, np.int64),
                "codes": pa.ListArray.from_arrays(offsets, pa.array((each % size).astype(np.int32))), "times": pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))),
                "pairs": once(pairs), "pair_times": once(times),
            })

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, {_COLUMNS}")


def id_pair(a: int, b: int) -> int:
    """The number that stands for a pair of ids."""
    return a * _A + b


def link_counts(dictionary: DataFrame) -> DataFrame:
    """pair, count, best of (pair, n) rows: how many links hold an id pair linked, and whether no pair
    of the same B id has more.  Sums are made in the tasks first; a B id has a bounded number of partners."""
    counts = materialise(dictionary.groupBy("pair").agg(F.sum("n").alias("count")), "link-counts").withColumn("b", F.col("pair") % _A)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """doc_id, all columns of aligned (see align; materialised) but the block's, and of each document's
    links: n_best, those whose count is their B id's highest, and count_sum, the sum of their counts."""
    words = aligned.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("code", "x"))
    words = words.select("of", "code", F.col("x.pairs").alias("pair"), F.col("x.pair_times").alias("n"))
    counted = words.join(link_counts(words.select("pair", "n")), "pair").select("of", "code", "count", "best")
    rows = aligned.drop("pairs", "pair_times")
    keep = [c for c in rows.columns if c not in ("block", "codes", "times")]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in keep) + ", n_best long, count_sum long"

    def add(rows: pa.Table, words: pa.Table) -> pa.Table:
        count, best = np.zeros(words.num_rows, np.int64), np.zeros(words.num_rows, np.int64)
        at = words["code"].to_numpy()
        count[at], best[at] = words["count"].to_numpy(), words["best"].to_numpy(zero_copy_only=False)
        codes, times = rows["codes"].combine_chunks(), rows["times"].combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
        code, n = codes.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        def total(of: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(n * of[code])])
            edge = np.searchsorted(row, np.arange(rows.num_rows + 1))
            return run[edge[1:]] - run[edge[:-1]]

        return rows.select(keep).append_column("n_best", pa.array(total(best), pa.int64())).append_column("count_sum", pa.array(total(count), pa.int64()))

    return rows.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(add, schema)
