"""Merging external judgments into ranked sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.shared import bounded_broadcast, materialise, numbered

# Sources that are kept, what a missing judgment says, the score of a failed judge.
SOURCES = 4
NO_RATIONALE = "No rationale returned"
FALLBACK_SCORE = 5.0
FALLBACK_RATIONALE = "Judge failed: neutral score, original order"


def original_ranks(candidates: DataFrame, order: str = "doc_id") -> DataFrame:
    """candidates with original_rank: their place in store order, whatever retrieval's was."""
    return candidates.withColumn("original_rank", F.row_number().over(W.partitionBy("query_id").orderBy(order)))


def merge_judgments(candidates: DataFrame, judgments: DataFrame, failed: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """query_id, doc_id, original_rank, new_rank, llm_score, rationale, judge_failed.

    Of several judgments (query_id, doc_id, llm_score, rationale, seq) the last counts; a missing one scores 0.
    For the query_ids of failed, all score 5 and stay in order."""
    last = judgments.groupBy("query_id", order).agg(F.max_by(F.struct("llm_score", "rationale"), "seq").alias("j"))
    rows = original_ranks(candidates, order).join(last, ["query_id", order], "left")
    if failed is None:
        rows = rows.withColumn("judge_failed", F.lit(False))
    else:
        marks = failed.select("query_id").distinct().withColumn("f", F.lit(True))
        rows = rows.join(marks, "query_id", "left").withColumn("judge_failed", F.coalesce("f", F.lit(False))).drop("f")
    score = F.when(F.col("judge_failed"), F.lit(FALLBACK_SCORE)).otherwise(F.coalesce(F.col("j.llm_score"), F.lit(0.0)))
    why = F.when(F.col("judge_failed"), FALLBACK_RATIONALE).otherwise(F.coalesce(F.col("j.rationale"), F.lit(NO_RATIONALE)))
    rows = rows.withColumn("llm_score", score.cast("double")).withColumn("rationale", why).drop("j")
    w = W.partitionBy("query_id").orderBy(F.desc("llm_score"), "original_rank")
    return rows.withColumn("new_rank", F.row_number().over(w))


def final_sources(reranked: DataFrame, n: int = SOURCES) -> DataFrame:
    """The first n, with their position."""
    return reranked.where(F.col("new_rank") <= n).withColumn("position", F.col("new_rank"))


def lookup_sources(sources: DataFrame, store: DataFrame, order: str = "doc_id") -> DataFrame:
    """sources with the store's columns; those the store lacks go.  The store's texts aren't shuffled where sources are few."""
    return store.join(bounded_broadcast(materialise(sources, "sources")), order)


def candidates_in_store_order(store: DataFrame, candidates: DataFrame, order: str = "doc_id") -> DataFrame:
    """The store's rows that any question has as a candidate, with place, their 0-based number in store order."""
    wanted = materialise(candidates.select(order).distinct(), "wanted")
    return numbered(store.join(bounded_broadcast(wanted), order, "left_semi"), [F.col(order)], "place")
