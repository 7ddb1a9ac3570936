"""Overlapping chunks of texts, by the largest boundary that fits.

A chunk is always a span of its text: whole pieces packed while they fit, starting with the end of
the chunk before it.  Spans still too long are cut by the next smaller boundary.  The spans depend on each
other in order, so they are found in one Arrow-batched Python function per document; all else is
DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import trim_all
from corpusloom.sources.shared import small_batches

SIZE, OVERLAP = 600, 80
# Boundaries from large to small; after them come single characters.
BOUNDARIES = [re.compile(p) for p in (r"\n\n+", r"\n", r"\.(?=\s|$)", r"[,;:](?=\s|$)", r"\s+")]


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each chunk of text."""

    def within(lo: int, hi: int, level: int) -> Iterator[tuple[int, int]]:
        if hi - lo <= size:
            yield lo, hi
            return
        if level < len(BOUNDARIES):
            ends = [m.end() for m in BOUNDARIES[level].finditer(text, lo, hi)]
            if not ends or ends[-1] < hi:
                ends.append(hi)
        else:
            ends = range(lo + 1, hi + 1)
        start, stop = lo, lo
        for end in ends:
            if end - start > size and stop > start:
                yield from within(start, stop, level + 1) if stop - start > size else [(start, stop)]
                start = max(start, stop - overlap)
            stop = end
        yield from within(start, stop, level + 1) if stop - start > size and level < len(BOUNDARIES) else [(start, stop)]

    return list(within(0, len(text), 0))


def chunk_documents(docs: DataFrame, enrich: bool = False, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, doc_id, title, content, chunk_index, start_offset, raw_length from (doc_id, title, content).

    enrich puts the title before the text, as for the index; offsets then count from the title.
    Null text counts as empty and gives one empty chunk.
    """
    content = F.coalesce("content", F.lit(""))
    text = F.concat_ws("\n\n", "title", content) if enrich else content
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "title", text.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc, title, text[a:b], k, a, b - a)
                for doc, title, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "title", "text")))
                for k, (a, b) in enumerate(spans(text, size, overlap), 1)
            ]
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (batch.schema.field("doc_id").type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "title", "raw", "chunk_index", "start_offset", "raw_length"])

    chunks = rows.mapInArrow(cut, f"doc_id {kind}, title string, raw string, chunk_index int, start_offset int, raw_length int")
    return chunks.select(
        F.concat("doc_id", F.lit("#chunk-"), "chunk_index").alias("chunk_id"), "doc_id", "title",
        trim_all(F.col("raw")).alias("content"), "raw", "chunk_index", "start_offset", "raw_length",
    )


def character_windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, start_offset, content: plain windows, the last resort's result, natively."""
    last = F.greatest(F.lit(0), F.ceil((F.length("content") - size) / (size - overlap)).cast("int"))
    k = docs.select("doc_id", F.coalesce("content", F.lit("")).alias("content")).select("doc_id", "content", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("k") * (size - overlap)
    return k.select("doc_id", (F.col("k") + 1).alias("chunk_index"), start.alias("start_offset"), F.substring(F.col("content"), start + 1, F.lit(size)).alias("content"))


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_count, chunk_ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"])
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), ids.alias("chunk_ids"))
