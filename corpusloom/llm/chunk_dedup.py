"""Repeated passages by content-defined chunking.

A gear rolling hash over UTF-8 bytes cuts texts where its top bits are zero; as the hash sees the
last 32 bytes only, cuts after an insertion fall where they fell before it.  Chunks are
deduplicated by digest; neighbouring repeated chunks of a text join to passages.

Chunks are shuffled once by digest.  A digest that very many documents hold (a common line) is
dealt to several parts by salt, whose least and greatest holders are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bounded_broadcast, materialise, small_batches
from .words import count_repeats, mix, text_slices

#: Least and most bytes of a chunk; a byte past the least ends it with chance 2 ** -CUT_BITS.
LEAST, MOST, CUT_BITS = 14, 2048, 4
#: Words that begin within a passage for it to be reported.  Whole chunks alone are seen, so this
#: must be well below the length of the passages to be found.
MIN_WORDS = 28
#: A digest counts towards the estimate of frequent ones in a task that holds it this often; those
#: with more chunks than all / (partitions * SHARE), and than HEAVY, get salts.
LOCAL_COUNT, SHARE, HEAVY = 4, 4, 1000

_rng = np.random.default_rng(987654321)
_GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_DIGEST = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = int(_rng.integers(1, 2**62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        size = max(n, 1 << 21)
        for base in (_FACTOR, pow(_FACTOR, -1, 2**64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _tables.append(np.cumprod(p))
    return _tables[0], _tables[1]


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each place: the sum of gear[b] << age, by doubling."""
    h = _GEAR[data]
    age = 1
    while age < 32:
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
        age *= 2
    return h


def cut(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ends of the chunks of each row, rows being byte offsets into data."""
    marks = np.flatnonzero(rolling(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = np.searchsorted(marks, rows)
    marks = marks.tolist()
    ends: list[int] = []
    for k in range(len(rows) - 1):
        begin, stop = int(rows[k]), int(rows[k + 1])
        for m in marks[at[k] : at[k + 1]]:
            while m - begin > MOST:
                begin += MOST
                ends.append(begin)
            if m - begin >= LEAST and m < stop:
                ends.append(m)
                begin = m
        while stop - begin > MOST:
            begin += MOST
            ends.append(begin)
        if stop > begin:
            ends.append(stop)
    return np.array(ends, np.int64)


def _sliced(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets, starts, ends, digests) of the chunks of each slice of texts."""
    for first, _, data, rows in text_slices(column):
        ends = cut(data, rows)
        if len(ends):
            starts = np.concatenate([[0], ends[:-1]])
            power, inverse = _powers(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_DIGEST[data] * power[: len(data)], out=total[1:])
            yield first, data, rows, starts, ends, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _frequent(rows: DataFrame, parts: int) -> dict[int, int]:
    """Digests that would fill a part when dealt out by digest, with the parts to deal each to: at
    most parts * SHARE of them.  Estimates, which only shape the plan."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_repeats((d for batch in batches for *_, d in _sliced(batch.column("text"))), LOCAL_COUNT)

    counted = rows.select("text").mapInArrow(task, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    # the number of all comes first, with h null
    first = counted.orderBy(F.col("h").isNotNull(), F.desc("c"), "h").limit(parts * SHARE + 1).collect()
    total = sum(r["c"] for r in first if r["h"] is None)
    most = max(HEAVY, total // (parts * SHARE))
    return {r["h"]: int(r["c"] // most) + 1 for r in first if r["h"] is not None and r["c"] > most}


def _chunks(rows: DataFrame, frequent: dict[int, int], keys: list[str]) -> DataFrame:
    """digest, salt, keys and place of each chunk; salt is 0 but for frequent digests."""
    known = np.array(sorted(frequent), np.int64)
    split = np.array([frequent[k] for k in known.tolist()], np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = {k: batch.column(k).to_numpy() for k in keys}
            for first, data, rows, starts, ends, digest in _sliced(batch.column("text")):
                row = np.searchsorted(rows, starts, "right") - 1
                # characters and words that begin before each byte
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                begins = ~_SPACE[data]
                begins[1:] &= _SPACE[data[:-1]]
                heads = rows[:-1][rows[:-1] < len(data)]
                begins[heads] = ~_SPACE[data[heads]]
                words = np.zeros(len(data) + 1, np.int64)
                np.cumsum(begins, out=words[1:])
                place = (chars[starts] - chars[rows[row]]) << 24 | (chars[ends] - chars[starts]) << 12 | (words[ends] - words[starts])
                own, digest = {k: v[first + row] for k, v in names.items()}, digest.view(np.int64)
                salt = np.zeros(len(digest), np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
                    dealt = mix(own["doc_id"].astype(np.uint64)) % split[at].astype(np.uint64)
                    salt = np.where(known[at] == digest, dealt.astype(np.int32) + 1, salt)
                yield pa.record_batch({"digest": digest, "salt": salt, **own, "place": place})

    return rows.mapInArrow(task, f"digest long, salt int, {', '.join(f'{k} long' for k in keys)}, place long")


def _rows(docs: DataFrame) -> tuple[DataFrame, list[str], DataFrame | None]:
    """Rows to be cut (doc_id, text and, where doc_ids repeat, alt), the columns that tell them apart,
    and the repeated doc_ids.

    alt is a hash of the text for repeated doc_ids, 0 for others; equal rows become one."""
    repeated = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not repeated.limit(1).count():
        return rows, ["doc_id"], None
    rows = with_alt(rows, repeated)
    once = rows.where("alt <> 0").groupBy("doc_id", "alt").agg(F.first("text").alias("text"))
    return rows.where("alt = 0").unionByName(once), ["doc_id", "alt"], repeated


def with_alt(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with alt, see _rows."""
    marked = rows.join(bounded_broadcast(repeated.withColumn("again", F.lit(True))), "doc_id", "left")
    alt = F.when(F.col("again"), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("alt", alt).drop("again")


def _passages(docs: DataFrame, min_words: int) -> tuple[DataFrame, list[str], DataFrame | None]:
    small_batches(docs.sparkSession)
    rows, keys, repeated = _rows(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = _frequent(rows, parts)
    # the chunks of a digest (of one of its salts) meet once; a frequent one's salts are merged after
    dealt = _chunks(rows, frequent, keys).repartition("digest", "salt")
    of = W.partitionBy("digest", "salt")
    again = dealt.withColumn("least", F.min("doc_id").over(of)).withColumn("most", F.max("doc_id").over(of)).where("least < most OR salt > 0")
    if frequent:
        again = materialise(again, "chunks")
        merged = again.where("salt > 0").groupBy("digest").agg(F.min("least").alias("all_least"), F.max("most").alias("all_most"))
        again = again.join(F.broadcast(merged), "digest", "left")
        again = again.withColumn("least", F.coalesce("all_least", "least")).withColumn("most", F.coalesce("all_most", "most")).where("least < most")
    start = F.shiftright("place", 24)
    end = start + F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    words = F.col("place").bitwiseAND(F.lit(4095))
    order = W.partitionBy(*keys).orderBy(start, end)
    joined = again.select("digest", *keys, "place", "least")
    joined = joined.withColumn("new", F.when(start > F.lag(end, 1, -1).over(order), 1).otherwise(0))
    joined = joined.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = joined.withColumn("run_words", F.sum(words).over(W.partitionBy(*keys, "run"))).where(F.col("run_words") >= min_words)
    held = materialise(joined.select("digest", *keys, "place", "least", "run"), "passages")
    # digests that the least holder has outside of passages
    moved = held.groupBy("digest").agg(F.min("doc_id").alias("now"), F.min("least").alias("least")).where("now > least").select("digest", "now")
    first = held.join(bounded_broadcast(materialise(moved, "moved")), "digest", "left").select(
        *keys, "run", start.alias("start"), end.alias("end"), words.alias("words"), F.coalesce("now", "least").alias("first_doc_id")
    )
    first = first.withColumn("is_first", F.col("first_doc_id") == F.col("doc_id"))
    order = W.partitionBy(*keys, "run").orderBy("start", "end")
    turn = F.when(F.col("is_first") != F.lag("is_first").over(order), 1).otherwise(0)
    first = first.withColumn("turn", turn).withColumn("stretch", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = first.groupBy(*keys, "run", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"),
        F.min_by("first_doc_id", "start").alias("first_doc_id"), F.first("is_first").alias("is_first"),
    )
    return found.drop("run", "stretch"), keys, repeated


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages are runs of min_words and more, of chunks that stand in other documents too.

    Of all documents with a chunk in a passage, the one with the least doc_id has it first.  A
    passage gives a row, or, where some of its chunks are first here and others are not, a row per
    stretch of either (of fewer words, then): doc_id, start, end (code points, end exclusive),
    n_words (that begin in it), n_chunks, first_doc_id (that has its first chunk first), is_first
    (that is this document, for each of its chunks).

    Repeats within one document don't count.  Null and empty texts have none; rows with a null
    doc_id are left out.  Rows of one doc_id with several texts are one document, whose passages
    are found text by text; rows equal in both count once.  Very long texts are read whole; other
    columns are ignored; an empty table gives no rows.
    """
    return _passages(docs, min_words)[0].drop("alt")


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with column deduplicated (one of that name is replaced): the text without passages that
    stand elsewhere first.

    Rows that share a doc_id each lose passages of their own text only; rows with a null doc_id and
    null texts stay as they are; so do other columns, whatever their names."""
    found, keys, repeated = _passages(docs, min_words)
    # stretches of one text, of which there are at most as many as it has words
    spans = found.where("NOT is_first").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    rows = (rows if repeated is None else with_alt(rows, repeated)).join(spans, keys, "left")
    # what lies between spans
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "deduplicated"]
    return rows.select(*kept, text.alias("deduplicated"))
