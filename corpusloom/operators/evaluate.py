"""Retrieval quality over relevance labels (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, precision, recall, reciprocal_rank for each query with labels; no relevant hit gives 0."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    size = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    good = hits.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("n_good"), F.min("rank").alias("first"))
    rows = total.join(size, "query_id", "left").join(good, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.col(b), F.lit(0.0))
    return rows.select("query_id", ratio("n_good", "n_hits").alias("precision"), ratio("n_good", "n_relevant").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(per: DataFrame) -> DataFrame:
    return per.agg(F.round(F.avg("precision"), 6).alias("precision_at_k"), F.round(F.avg("recall"), 6).alias("recall_at_k"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
