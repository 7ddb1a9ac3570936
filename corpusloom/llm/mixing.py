"""Mixing sources to target weights by subset-sum budget fitting.

Per source the target holds some whole passes over its documents and a remaining budget.  The
remaining budget is fitted on counts of documents by exact length: first each length's share, then
the longest that fit while more than EXACT_WORDS are left, then a bounded-knapsack dynamic program
over the rest; once more with smaller shares where that misses the budget.  Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bounded_broadcast, discard, materialise, numbered

#: Weights of the sources in order of their names (null last), repeating; the mix's size as a share
#: of all; how often a document may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Remaining words for which the dynamic program runs; more are first filled by the longest documents.
EXACT_WORDS = 1 << 16
#: Parts into which the documents of one source and length are dealt, so that none is ranked in one task.
BUCKETS = 1024
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most counts, so that lengths sum to budget, or the most
    below it that is found: the best there is for a budget of EXACT_WORDS or less, else with that many
    words left to the dynamic program.  Each length first gets its share, as far as that leaves the sum in reach."""
    total = int(lengths @ counts)
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    best = np.zeros(len(lengths), np.int64)
    for shared in (budget, max(0, budget - EXACT_WORDS)):
        take = _filled(lengths, counts, budget, np.minimum(counts, np.floor(counts * (shared / total)).astype(np.int64)))
        best = max(best, take, key=lambda t: int(lengths @ t))
        if int(lengths @ best) == budget:
            break
    return best


def _filled(lengths: np.ndarray, counts: np.ndarray, budget: int, take: np.ndarray) -> np.ndarray:
    """take with more of each length: the longest while over EXACT_WORDS are left, then the best by dynamic programming."""
    rest = budget - int(lengths @ take)
    order = np.argsort(lengths)
    for k in order[::-1].tolist():
        if rest <= EXACT_WORDS:
            break
        more = int(min(counts[k] - take[k], (rest - EXACT_WORDS) // lengths[k] + 1, rest // lengths[k]))
        take[k] += more
        rest -= more * int(lengths[k])
    # reachable sums as bits of a whole number, with the state before each item for the way back
    mask, bits, trail = (1 << (rest + 1)) - 1, 1, []
    for k in order.tolist():
        size, left = int(lengths[k]), int(counts[k] - take[k])
        if size > rest or bits >> rest & 1:
            break
        left, piece = min(left, rest // size), 1
        while left > 0:
            piece = min(piece, left)
            trail.append((k, piece, bits))
            bits |= bits << (size * piece) & mask
            left, piece = left - piece, piece * 2
    at = bits.bit_length() - 1
    for k, piece, before in reversed(trail):
        if not before >> at & 1:
            take[k] += piece
            at -= piece * int(lengths[k])
    return take


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one per source.

    Targets are shares of the budget by weight; they stop at repeats times the source's size, and
    the excess is shared by weight among the others: the least of the cap and weight times a common
    level.  The level rises as sources reach their caps, round by round, each an aggregate.
    """
    s = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = materialise(s.drop("place").withColumn("cap", F.col("source_size").cast("double") * repeats), "weights")
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        open_ = F.col("cap") >= F.col("weight") * level
        row = s.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(~open_, F.col("cap"))), F.lit(0.0)).alias("c")).first()
        if row["w"] is None:  # all at their caps
            level = float("inf")
            break
        if level >= (now := (budget - row["c"]) / row["w"]):
            break
        level = now
    return s.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, text, ...) with size, key (of the source), h, th and bucket."""
    sized = rows.withColumn("size", word_count(F.col("text"))).withColumn("key", _key()).withColumn("th", F.xxhash64("text"))
    # rows that share a doc_id are told apart by their text
    return sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "th")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _quotas(sized: DataFrame, weights: tuple, share: float, repeats: int) -> tuple[DataFrame, DataFrame]:
    """Per source (key, source_size, target); per key, size and bucket the passes over all of its
    rows and how many of them have room in a further one."""
    targets = source_targets(sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, share, repeats)
    targets = materialise(targets.withColumn("key", _key()).select("key", "source_size", "target"), "targets")
    parts = materialise(sized.where("size > 0").groupBy("key", "size", "bucket").agg(F.count("*").alias("c")), "counts")
    lengths = parts.groupBy("key", "size").agg(F.sum("c").alias("c")).join(bounded_broadcast(targets), "key")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(repeats, int(target // size))
        rest = 0 if passes == repeats else int(target - passes * size)
        more = fit_budget(pdf["size"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), rest)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "passes": passes, "more": more})

    # a group holds the distinct lengths of one source, however many documents there are
    fitted = lengths.groupBy("key").applyInPandas(fit, "key string, size long, passes long, more long")
    upto = W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    quota = parts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).join(fitted, ["key", "size"])
    return targets, quota.select("key", "size", "bucket", "passes", (F.col("more") - F.col("before")).alias("room"))


def _times(sized: DataFrame, quota: DataFrame) -> DataFrame:
    """sized with times, how often the mix takes the row."""
    rank = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("h", "doc_id", "th"))
    chosen = sized.withColumn("rank", rank).join(quota, ["key", "size", "bucket"], "left")
    times = F.coalesce(F.col("passes") + F.when(F.col("rank") <= F.col("room"), 1).otherwise(0), F.lit(0))
    return chosen.withColumn("times", times.cast("int")).drop("rank", "passes", "room")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, times for each row.

    size counts words (null text: 0).  A null source is a source of its own, in the last place.
    taken is size times the number of passes that take the row; rows without words get 0.  Each
    row counts, repeated doc_ids too (rows equal in doc_id, text and source may swap places); sums
    of taken stay at or below the whole part of targets.  Very long texts are counted whole; other
    columns are ignored; an empty table gives no rows.
    """
    sized = materialise(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    targets, quota = _quotas(sized, weights, share, repeats)
    return _times(sized, quota).join(bounded_broadcast(targets), "key").select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times"
    )


def take_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """docs, with all columns, each row as often as the mix takes it (see mix).

    Rows, not ids, are taken: those that share a doc_id, or have none, each by its own number.
    Other columns may have any names; an empty table gives no rows."""
    counted = materialise(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    _, quota = _quotas(counted, weights, share, repeats)
    discard(counted)
    # columns of docs travel in one, where no name clashes; rows are ranked again, with all they have
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = _keyed(rows.select("row", *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text"))), seed)
    rows = _times(rows.where("size > 0").select("row", "doc_id", "key", "size", "bucket", "h", "th"), quota).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")
