"""Run traces: one row per stage of a run, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def steps_of(runs: DataFrame) -> DataFrame:
    """run_id and the step records of nested runs, input and output as JSON."""
    s = runs.select("run_id", F.explode("steps").alias("s"))
    as_json = lambda c: F.to_json(F.col(c)) if dict(s.select("s.*").dtypes).get(c.split(".")[-1], "").startswith(("struct", "array", "map")) else F.col(c).cast("string")
    return s.select("run_id", "s.id", "s.agent", "s.label", "s.startedAt", "s.finishedAt", "s.durationMs", "s.status", as_json("s.input").alias("input"), as_json("s.output").alias("output"))


def sources_of(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.posexplode("sources").alias("pos", "s")).select("run_id", (F.col("pos") + 1).alias("position"), "s.*")


def run_summary(steps: DataFrame) -> DataFrame:
    """run_id, any_error, n_steps, total_ms from (run_id, status, started_at, finished_at)."""
    return steps.groupBy("run_id").agg(
        F.bool_or(F.col("status") == "error").alias("any_error"), F.count("*").alias("n_steps"), (F.max("finished_at") - F.min("started_at")).alias("total_ms")
    )


def latency_share(steps: DataFrame) -> DataFrame:
    """agent, n, mean_ms, share of all durations."""
    by = steps.groupBy("agent").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.sum("duration_ms").alias("sum_ms"))
    total = steps.agg(F.sum("duration_ms").alias("all_ms"))
    return by.crossJoin(F.broadcast(total)).select("agent", "n", F.round("mean_ms", 4).alias("mean_ms"), F.round(F.col("sum_ms") / F.col("all_ms"), 6).alias("share"))


def assemble_runs(questions: DataFrame, outcome: DataFrame, sources: DataFrame, steps: DataFrame) -> DataFrame:
    """query_id, run: JSON of question, answer, sources and steps."""
    s = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id", "llm_score"))).alias("sources"))
    t = steps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("started_at", "agent", "status", "duration_ms"))).alias("steps"), F.sum("duration_ms").alias("totalDurationMs"))
    rows = questions.join(outcome, "query_id", "left").join(s, "query_id", "left").join(t, "query_id", "left")
    return rows.select("query_id", F.to_json(F.struct("question", "answer", "sources", "steps", "totalDurationMs")).alias("run"))


def latest_turn(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, turn, text of the last turn of a role."""
    last = conversations.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("t"))
    return last.select("conv_id", "t.turn", "t.text")


def variant_steps(runs: DataFrame) -> DataFrame:
    """run_id, pos, step (variant) of runs (run_id, run variant); pos counts from 0.  Runs without an array of steps have none."""
    steps = F.try_variant_get("run", "$.steps", "array<variant>")
    return runs.select("run_id", F.posexplode(steps).alias("pos", "step"))


#: Typed fields of a step's output: name, the agents that give it, path, type.
FIELDS = (
    ("query_type", ("router",), "$.output.queryType", "string"),
    ("needs_retrieval", ("router",), "$.output.needsRetrieval", "boolean"),
    ("verdict", ("critic",), "$.output.verdict", "string"),
    ("faithfulness", ("critic",), "$.output.faithfulnessScore", "double"),
    ("final_verdict", ("coordinator",), "$.output.finalVerdict", "string"),
    ("iterations", ("coordinator",), "$.output.totalIterations", "int"),
)


def typed_steps(steps: DataFrame) -> DataFrame:
    """Columns of variant_steps' rows: run_id, pos, id, agent, status, started_at, finished_at, error,
    FIELDS, and n_items and top_score of retrieved or reranked items, answer_length of an analyzer.

    A field that its step lacks, or has of a kind that can't be cast, is null; so are all fields of a step
    that is no object.  Items without a score count, but have none."""
    get = lambda path, kind: F.try_variant_get("step", path, kind)
    agent = get("$.agent", "string")
    fields = [F.when(agent.isin(*agents), get(path, kind)).alias(name) for name, agents, path, kind in FIELDS]
    items = F.when(agent == "retriever", get("$.output.candidates", "array<variant>")).when(agent == "reranker", get("$.output.reranked", "array<variant>"))
    score = lambda item: F.coalesce(F.try_variant_get(item, "$.llmScore", "double"), F.try_variant_get(item, "$.score", "double"))
    return steps.select(
        "run_id", "pos", get("$.id", "string").alias("id"), agent.alias("agent"), get("$.status", "string").alias("status"),
        get("$.startedAt", "bigint").alias("started_at"), get("$.finishedAt", "bigint").alias("finished_at"), get("$.error", "string").alias("error"), *fields,
        F.when(items.isNotNull(), F.size(items)).alias("n_items"), F.array_max(F.transform(items, score)).alias("top_score"),
        F.when(agent == "analyzer", F.length(get("$.output.answer", "string"))).alias("answer_length"),
    )
