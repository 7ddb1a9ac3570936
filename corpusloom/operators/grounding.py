"""Contexts for answers, and the audit of answers and verdicts supplied as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import citation_count, judge_excerpt, unwrap_answer
from corpusloom.sources.shared import bounded_broadcast, materialise

ROUNDS, FAITHFUL_SCORE = 2, 85


def sources_block(sources: DataFrame) -> DataFrame:
    """query_id, block from (query_id, position, title, chunk_index, content)."""
    items = F.array_sort(F.collect_list(F.struct("position", "title", "chunk_index", "content")))
    # The form of a source and what separates two.
    line = lambda s: F.concat(F.lit("["), s["position"], F.lit('] (from "'), s["title"], F.lit('", chunk '), s["chunk_index"], F.lit(")\n"), s["content"])
    return sources.groupBy("query_id").agg(F.array_join(F.transform(items, line), "\n\n---\n\n").alias("block"))


def _sections(*parts: tuple[str, Column]) -> Column:
    """Parts under their headings; those that are null or empty are left out."""
    texts = [F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), text)) for name, text in parts]
    return F.concat_ws("\n\n", *texts)


def answer_request(question: Column, kind: Column, block: Column, notes: Column, iteration: Column) -> Column:
    """What a writer of answers is sent: question, its type, sources and, in later rounds, the notes on the last answer."""
    again = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("Round "), iteration, F.lit(": "), notes))
    return _sections(("Asked", question), ("Kind", kind), ("Sources, cited by number", block), ("To mend", again))


def critique_request(question: Column, answer: Column, block: Column) -> Column:
    """What a judge of answers is sent: question, answer and sources."""
    return _sections(("Asked", question), ("Answered", answer), ("Sources to hold it against", block))


def judge_payload(candidates: DataFrame) -> DataFrame:
    """query_id, payload: JSON of the candidates (chunk_id, title, content, original_rank) in order."""
    item = F.struct(F.col("original_rank").alias("originalRank"), F.col("chunk_id").alias("chunkId"), F.col("title").alias("documentTitle"), judge_excerpt(F.col("content")).alias("text"))
    return candidates.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def routed(questions: DataFrame, plans: DataFrame) -> DataFrame:
    """questions with query_type, rewritten_query, needs_retrieval; a missing plan asks as it is."""
    p = plans.select("query_id", "query_type", "rewritten_query", "needs_retrieval")
    return questions.join(p, "query_id", "left").select(
        "query_id", "question", F.coalesce("query_type", F.lit("factual")).alias("query_type"),
        F.coalesce("rewritten_query", "question").alias("rewritten_query"), F.coalesce("needs_retrieval", F.lit(True)).alias("needs_retrieval"),
    )


def audited_verdicts(verdicts: DataFrame) -> DataFrame:
    """verdicts with defaults for failed judges (kept visible), and whether verdict and score agree."""
    failed = F.coalesce("judge_failed", F.lit(False))
    verdict = F.when(failed, "faithful").otherwise(F.col("verdict"))
    score = F.when(failed, 100.0).otherwise(F.col("faithfulness_score"))
    rule = F.when(score >= FAITHFUL_SCORE, "faithful").otherwise("needs_revision")
    return verdicts.withColumn("judge_failed", failed).withColumn("faithfulness_score", score).withColumn("verdict", verdict).withColumn("verdict_mismatch", rule != F.col("verdict"))


def refine_outcome(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, iterations, verdict, answer, citations_used: the first faithful round, else the last of two."""
    v = audited_verdicts(verdicts).where(F.col("iteration") <= ROUNDS)
    # by query_id alone, rounds being few, so that the window needs no shuffle of the replies of its own
    rows = answers.join(v.withColumnRenamed("iteration", "judged"), "query_id").where(F.col("judged") - F.col("iteration") == 0).withColumn("ok", F.col("verdict") == "faithful")
    place = W.partitionBy("query_id").orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("iteration")).otherwise(-F.col("iteration")))
    answer = unwrap_answer(F.col("raw_answer"))
    return rows.withColumn("place", F.row_number().over(place)).where("place = 1").select(
        "query_id", F.col("iteration").alias("iterations"), "verdict", answer.alias("answer"), citation_count(answer).alias("citations_used")
    )


def terminal_outcome(routed_questions: DataFrame, hit_counts: DataFrame, outcome: DataFrame) -> DataFrame:
    """query_id, outcome: skipped, no_candidates, faithful, needs_revision or unknown."""
    rows = routed_questions.join(hit_counts, "query_id", "left").join(outcome.select("query_id", "verdict"), "query_id", "left")
    return rows.select(
        "query_id",
        F.when(~F.col("needs_retrieval"), "skipped").when(F.coalesce("hits", F.lit(0)) == 0, "no_candidates").otherwise(F.coalesce("verdict", F.lit("unknown"))).alias("outcome"),
    )


def cited_sources(final: DataFrame, documents: DataFrame, zero_score: bool = False) -> DataFrame:
    """final (query_id, position, doc_id, score, llm_score) with title, authors, year and source; unknown
    documents get defaults.  zero_score sets score to 0, as the recorded runs have it.  Of documents only the cited ones are joined."""
    final = materialise(final, "final")
    wanted = materialise(final.select("doc_id").distinct(), "wanted")
    d = documents.select("doc_id", "title", "authors", "year", F.col("source")).join(bounded_broadcast(wanted), "doc_id", "left_semi")
    return final.join(bounded_broadcast(materialise(d, "cited")), "doc_id", "left").select(
        "query_id", "position", "doc_id", "title", F.coalesce("authors", F.lit("Unknown")).alias("authors"), F.coalesce("year", F.lit(0)).alias("year"),
        F.coalesce("source", F.lit("")).alias("source"), F.lit(0.0).alias("score") if zero_score else F.col("score"), "llm_score",
    )
