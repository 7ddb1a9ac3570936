"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal) updates.

Tokens are runs of letters (hashed in lower case), of digits and of marks; a second sequence holds
their shapes (lower, capital, upper, mixed, number, marks, as before).  Features are token
unigrams and bigrams and shape bigrams and trigrams, hashed to 2 ** BITS, and a bias in the place
behind them; a text's vector is their relative frequencies.
Scores are dot products of these sparse vectors with the weights.

Training: a bounded sample of labelled rows in hashed order is dealt to SHARDS groups; each is
trained on its own, and the weights are averaged (parameter mixing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import mix, text_slices

BITS = 18
BIAS = 1 << BITS
#: Labelled rows used at most, and the groups they are dealt to.
TRAIN_ROWS, SHARDS = 16_384, 8
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-4
#: Scale of the relative frequencies.
SCALE = 16.0
THRESHOLD = 0.7

_rng = np.random.default_rng(424242)
_ODD = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[48:58] = _BYTE[48]
# classes of bytes: 0 white space, 1 letter, 2 digit, 3 mark
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2 (a null doc_id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, hashed features, each row's first feature (n + 1 entries))."""
    mask = np.uint64((1 << BITS) - 1)
    for first, last, data, rows in text_slices(column):
        kind = _CLASS[data]
        edge = np.ones(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = kind[1:] != kind[:-1]
        edge[rows] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        full = kind[starts] > 0
        starts, ends = starts[full], ends[full]
        # marks repeat freely: their number counts up to 3
        upper = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 65) & (data < 91), out=upper[1:])
        n, up = ends - starts, upper[ends] - upper[starts]
        k = kind[starts]
        shape = np.where(k == 1, np.where(up == 0, 1, np.where((up == n) & (n > 1), 3, np.where((up == 1) & (data[starts] < 91), 2, 4))), 0)
        shape = np.where(k == 2, 5, np.where(k == 3, 5 + np.minimum(n, 3), shape)).astype(np.uint64)
        weights = np.zeros(len(data) + 1, np.uint64)
        # order within a token counts by its place, through powers of an odd number
        place = np.arange(len(data)) - np.repeat(cuts[:-1], np.diff(cuts))
        power = _ODD[0] ** np.minimum(place, 64).astype(np.uint64)
        np.cumsum(_BYTE[data] * power, out=weights[1:])
        token = mix(weights[ends] - weights[starts])
        at = np.searchsorted(starts, rows)
        row = np.repeat(np.arange(last - first), np.diff(at))
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
        shape = np.where(again, np.uint64(9), shape)
        out, owner = [], []

        def grams(x: np.ndarray, size: int, salt: int) -> None:
            m = len(x) - size + 1
            if m <= 0:
                return
            h = np.full(m, np.uint64(salt))
            for j in range(size):
                h += x[j : j + m] * _ODD[j + 1]
            same = row[size - 1 :] == row[:m]
            out.append((mix(h) & mask)[same].astype(np.int64))
            owner.append(row[:m][same])

        grams(token, 1, 11)
        grams(token, 2, 12)
        grams(shape, 2, 13)
        grams(shape, 3, 14)
        f, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out, owner))
        order = np.argsort(o, kind="stable")
        yield first, last, f[order], np.searchsorted(o[order], np.arange(last - first + 1))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights after EPOCHS passes over rows (features, values, label)."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for f, x, y in rows:
            w = weight(z[f], n[f])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    return weight(z, n)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most bound labelled rows (doc_id, quality) whose documents are in docs.

    The sample is the first in order of a hash of doc_id, so it doesn't depend on the layout.
    Null labels and ids are left out; a document that repeats, or has two labels, counts each time.
    Null and empty texts count as texts without features, very long ones are read whole.  Without
    any labelled row all weights are 0 (scores 0.5).  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    picked = picked.withColumn("h", F.xxhash64("doc_id", F.lit(29))).orderBy("h", "doc_id", "y").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            y, shard = batch.column("y").to_pylist(), batch.column("shard").to_pylist()
            for first, last, f, at in features(batch.column("text")):
                for k in range(last - first):
                    u, c = np.unique(f[at[k] : at[k + 1]], return_counts=True)
                    bias = np.append(u, BIAS), np.append(c * (SCALE / max(1, c.sum())), 1.0)
                    shards.setdefault(shard[first + k], []).append((*bias, y[first + k]))
        for own in shards.values():
            w = ftrl(own)
            at = np.flatnonzero(w)
            yield pa.record_batch({"f": at, "w": w[at]})

    dealt = rows.withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int"))
    dealt = dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard", "h", "doc_id", "y", "text")
    # at most BIAS + 1 rows
    found = dealt.select("shard", "y", "text").mapInArrow(fit, "f long, w double").groupBy("f").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros(BIAS + 1)
    out[found["f"].to_numpy()] = found["w"].to_numpy() / SHARDS
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of each row; null and empty texts get the score of no features.

    Repeated doc_ids are rows of their own, null ones are kept; very long texts are read whole;
    other columns (also one called score) are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, last, f, at in features(batch.column("text")):
                total = np.concatenate([[0.0], np.cumsum(w[f])])
                n = np.diff(at)
                out[first:last] = w[BIAS] + SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")
