"""Language identification by interpolated Kneser-Ney character models, one per language.

Characters become 128 symbols: a to z, other letters by their code, and one for all else.  Trigram
counts of every labelled document are summed per language; the lower orders are the continuation
counts of Kneser-Ney.  The model is kept as arrays sorted by trigram hash; a text gets the
language of lowest cross-entropy per character.

Rejection: labelled documents show how far a document's cross-entropy strays from its language's
mean, in standard deviations for its length; texts further out than (almost) all of them get a low
score.  So do texts whose languages are close to each other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise, small_table

SYMBOLS = 128
DISCOUNT = 0.75
#: Characters that count at most for the certainty of a choice.
CERTAIN_CHARS = 40
#: The limit of the rejection: this quantile of all labelled documents, with this margin.
QUANTILE, MARGIN = 0.9995, 1.5
#: Score below which `identify` rejects a text.
ACCEPT = 0.5
UNKNOWN = "und"
SLICE_CHARS = 1 << 17
_symbols: np.ndarray | None = None


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of doc_id as text falls in the fold (a null doc_id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _symbol_table() -> np.ndarray:
    global _symbols
    if _symbols is None:
        n = sys.maxunicode + 1
        letters = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        table = np.where(letters, 27 + np.arange(n) % (SYMBOLS - 27), 0).astype(np.uint8)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _symbols = table
    return _symbols


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, trigram codes, each row's first code (n + 1 entries)).

    A code is counted for each letter and for the first other character after one; blanks, digits
    and marks are one symbol, and a word starts from it alone.
    """
    texts = ["" if t is None else t for t in column.to_pylist()]
    table = _symbol_table()
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end]) <= SLICE_CHARS):
            size += len(texts[end])
            end += 1
        part = [t.lower() for t in texts[row:end]]
        cp = np.frombuffer("\n\n".join(["", *part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = table[cp].astype(np.int64)
        a, b, c = s[:-2], s[1:-1], s[2:]
        a = np.where(b == 0, 0, a)
        use = (b > 0) | (c > 0)
        codes = (a << 14 | b << 7 | c)[use]
        starts = 2 + np.concatenate([[0], np.cumsum([len(t) + 2 for t in part])])
        before = np.concatenate([[0], np.cumsum(use)])
        # the trigram that ends at character k has number k - 2; a row owns those up to its separator
        yield row, end, codes, before[np.clip(starts - 2, 0, len(use))]
        row = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def merged() -> None:
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held[lang] = [(codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))]

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, last, codes, at in trigrams(batch.column("text")):
            names = langs[first:last]
            for lang in set(names):
                mine = np.concatenate([codes[at[k] : at[k + 1]] for k in range(last - first) if names[k] == lang])
                part = np.unique(mine, return_counts=True)
                held.setdefault(lang, []).append(part)
                size += len(part[0])
        if size > 1 << 21:
            merged()
            size = 0
    merged()
    for lang, ((codes, counts),) in held.items():
        yield pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "c": counts})


class Model:
    """Log-probabilities by sorted trigram hash, with the lower order for trigrams never seen."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.codes = np.unique(counts["code"].to_numpy(np.int64))
        n = len(self.langs)
        self.logs = np.zeros((len(self.codes), n), np.float32)
        self.weight = np.zeros((SYMBOLS**2, n), np.float32)  # log of the mass left to the lower order
        self.lower = np.zeros((SYMBOLS**2, n), np.float32)
        a, bc = self.codes >> 7, self.codes & (SYMBOLS**2 - 1)
        for k, lang in enumerate(self.langs):
            own = counts[counts["lang"] == lang]
            code, c = own["code"].to_numpy(np.int64), own["c"].to_numpy(np.float64)
            into = np.bincount(code & (SYMBOLS**2 - 1), minlength=SYMBOLS**2).astype(float)  # contexts of each bigram
            kinds = into.reshape(SYMBOLS, SYMBOLS)
            heads = np.bincount(np.flatnonzero(into) & (SYMBOLS - 1), minlength=SYMBOLS) + 0.5
            p1 = heads / heads.sum()
            total, some = kinds.sum(1, keepdims=True), (kinds > 0).sum(1, keepdims=True)
            p2 = np.where(total > 0, (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * some * p1) / np.maximum(total, 1), p1)
            context = np.bincount(code >> 7, c, SYMBOLS**2)
            follow = np.bincount(code >> 7, minlength=SYMBOLS**2)
            rest = np.where(context > 0, DISCOUNT * follow / np.maximum(context, 1), 1.0)
            seen = np.zeros(len(self.codes))
            seen[np.searchsorted(self.codes, code)] = c
            p3 = np.where(context[a] > 0, np.maximum(seen - DISCOUNT, 0) / np.maximum(context[a], 1), 0) + rest[a] * p2.ravel()[bc]
            self.logs[:, k], self.weight[:, k], self.lower[:, k] = np.log(p3), np.log(rest), np.log(p2.ravel())
        self.mean = np.zeros(n)
        self.spread = np.ones((2, n))  # variance of a document's mean, and per character
        self.limit = np.inf

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per row and language the cross-entropy per character; per row the characters counted."""
        if not hasattr(self, "place"):
            self.place = np.full(SYMBOLS**3, -1, np.int32)
            self.place[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        sums, sizes = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)]
        for first, last, codes, at in trigrams(column):
            p = self.place[codes]
            logs = self.logs[p]
            new = np.flatnonzero(p < 0)
            logs[new] = self.weight[codes[new] >> 7] + self.lower[codes[new] & (SYMBOLS**2 - 1)]
            total = np.zeros((len(codes) + 1, len(self.langs)))
            np.cumsum(logs, axis=0, dtype=np.float64, out=total[1:])
            sums.append(total[at[1:]] - total[at[:-1]])
            sizes.append(np.diff(at))
        n = np.concatenate(sizes)
        return -np.concatenate(sums) / np.maximum(n, 1)[:, None], n

    def strays(self, h: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        return (h - self.mean[best]) / np.sqrt(self.spread[0, best] + self.spread[1, best] / np.maximum(n, 1))

    def calibrate(self, rows: DataFrame) -> None:
        """From all labelled documents' cross-entropies in their own language and sizes: rows (k, h, n; materialised).

        The driver gets sums per language and two order statistics."""
        rows = rows.where("n > 0")
        means = rows.groupBy("k").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.count("*").alias("rows")).where("rows > 1")
        off = rows.join(F.broadcast(means), "k").select("k", "n", F.pow(F.col("h") - F.col("mean"), 2).alias("off"), (F.col("n") >= F.col("median")).alias("long"), "mean")
        first = off.groupBy("k", "mean").agg(F.avg(F.when(F.col("long"), F.col("off"))).alias("s0"), F.avg(F.when(~F.col("long"), F.col("off") * F.col("n"))).alias("a"), F.avg(F.when(~F.col("long"), F.col("n"))).alias("b"))
        for r in first.collect():
            # the mean of (off - s0) * n over the shorter ones
            s0 = max(r["s0"], 1e-6)
            self.mean[r["k"]], self.spread[0, r["k"]] = r["mean"], s0
            self.spread[1, r["k"]] = 1.0 if r["a"] is None else max(r["a"] - s0 * r["b"], 1.0)
        here = [{"k": k, "m": float(self.mean[k]), "s0": float(self.spread[0, k]), "s1": float(self.spread[1, k])} for k in range(len(self.langs))]
        spreads = F.broadcast(small_table(rows.sparkSession, here, "k long, m double, s0 double, s1 double"))
        stray = rows.join(spreads, "k").select(((F.col("h") - F.col("m")) / F.sqrt(F.col("s0") + F.col("s1") / F.col("n"))).alias("z"))
        if total := stray.count():
            at = (total - 1) * QUANTILE
            # the order statistics around the quantile end the few largest
            ends = [r["z"] for r in stray.orderBy(F.desc("z")).limit(total - int(at)).orderBy("z").limit(2).collect()]
            self.limit = (ends[0] + (at - int(at)) * (ends[-1] - ends[0])) * MARGIN

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not len(column) or not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        h, n = self.entropies(column)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        sure = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, CERTAIN_CHARS)[:, None]).sum(1)
        far = np.maximum(0, self.strays(low, n, best) - self.limit)
        score = np.where(n > 0, sure * np.exp(-np.minimum(far, 700)), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist())], score


def train(docs: DataFrame) -> Model:
    """Model of the languages of docs (lang, text; rows without lang are left out).

    Counts and the rejection's limit come from all rows.  At most SYMBOLS ** 3 counts per language reach the driver.
    """
    docs = docs.where("lang IS NOT NULL").select("lang", "text")
    counts = docs.mapInArrow(_count, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
    model = Model(counts.toPandas())
    if not model.langs:
        return model
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                h, n = m.entropies(batch.column("text"))
                k = np.searchsorted(m.langs, batch.column("lang").to_pylist())
                yield pa.record_batch({"k": k.astype(np.int64), "h": h[np.arange(len(h)), k], "n": n})

    rows = materialise(docs.mapInArrow(own, "k long, h double, n long"), "strays")
    model.calibrate(rows)
    discard(rows)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred and score, a row for each row.

    lang_pred is `und`, with score 0, where text is null or has no letter.  Score is near 1 for a
    text that one language fits alone and as well as it fits labelled documents.  Repeated doc_ids
    are rows of their own; very long texts are read whole; other columns (also one called
    lang_pred) are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = m.predict(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """docs, with all columns, without the texts that the model rejects: those without a letter,
    and those whose score is below accept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = m.predict(batch.column("text"))
            yield batch.filter(pa.array([a != UNKNOWN and b >= accept for a, b in zip(lang, score.tolist())], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
