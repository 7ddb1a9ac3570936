"""From raw documents to packed training sequences, stage by stage.

Each stage gets the documents that the one before kept, written and read again as Parquet.  What
holds for all: an empty table gives an empty one; each row is a document, also one that repeats a
doc_id or has none; texts are read whole, however long; columns beside doc_id, text, lang and source
pass through all stages but the last, whatever their names; null is read as below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import content_sort, language_id, mixing, ngram_join, packing
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.scratch import fresh_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: null texts, those without a letter, and those
    that no language fits.  Models are of the rows with a lang; without any, all documents go.
    Repeated rows are judged alike, each for itself; of equally near languages the first by name
    counts, with a low score."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z one row stays, that of the smallest doc_id (of rows
    equal in that too, any one).  A row with a null doc_id goes where a row with one stays; null and
    empty texts are equal."""
    return content_sort.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id stays; one with a null doc_id only
    where its group has no other.  Texts without words (null too) link with nothing and stay."""
    return ngram_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.  A null source is a source
    of its own; texts without words (null too) are not taken; of documents of one length a seeded
    hash of doc_id and text decides."""
    return mixing.take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences; a null text is a document of its end id alone."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train models, tokenise and run a dynamic program, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
