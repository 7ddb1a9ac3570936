"""TF-IDF vectors in long form: a row per text and term.

Counts are stored, weights derived: adding or removing texts changes every weight but few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS, words
from corpusloom.sources.shared import bounded_broadcast, numbered


def term_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf; texts without tokens have no rows.

    Texts are shuffled by key, once: they are smaller than their terms, and counts and later sums
    per text find them in place."""
    terms = texts.select(key, text).repartition(key).select(key, F.explode(words(F.col(text))).alias("term"))
    return terms.where(~F.col("term").isin(*STOPWORDS)).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def frequency_of(texts: DataFrame, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """term, df of texts, each row a text of its own: where counts per text aren't wanted.  Only terms with
    partial sums are shuffled.  only (term; materialised): of these terms alone."""
    terms = texts.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    if only is not None:
        terms = terms.join(bounded_broadcast(only.select("term")), "term", "left_semi")
    return terms.where(~F.col("term").isin(*STOPWORDS)).groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequency(df: DataFrame, texts: DataFrame) -> DataFrame:
    """term, df, idf with idf = ln((1 + N) / (1 + df)) + 1; N, one number, is broadcast."""
    total = texts.agg(F.count("*").alias("total"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", idf_of(F.col("total"), F.col("df")).alias("idf"))


def idf_of(total: Column, df: Column) -> Column:
    return F.log((1 + total) / (1 + df)) + 1


def vocabulary_index(df: DataFrame) -> DataFrame:
    """term, idx: 0-based place in sorted order, by a range sort (no single task holds all terms)."""
    return numbered(df.select("term"), [F.col("term")], "idx")


def weights(counts: DataFrame, idf: DataFrame, key: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """key, term, the columns of keep (of counts or idf), weight: tf by idf, of unit length; terms outside idf are dropped.

    (The share of a term in its text, tf over all, differs from tf by a factor that the length
    takes out again.)"""
    w = counts.join(idf.select("term", "idf"), "term").select(key, "term", *keep, (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return w.select(key, "term", *keep, (F.col("w") / norm).alias("weight"))


def top_terms(idf: DataFrame, k: int = 10) -> DataFrame:
    return idf.orderBy(F.desc("df"), "term").limit(k).select("term", "df", F.round("idf", 3).alias("idf"))


def store_stats(texts: DataFrame, df: DataFrame) -> DataFrame:
    return texts.agg(F.count("*").alias("num_chunks")).crossJoin(df.agg(F.count("*").alias("vocab_size")))
