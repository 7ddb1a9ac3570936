"""Exact cosine search for many questions at once, and diversified (MMR) choice.

The question side joins the postings on term: broadcast while its rows are few (they are counted),
else both are shuffled by term.  Scores are rounded to 9 places before ranking, so that equal texts
tie and store order decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import preview
from corpusloom.sources.shared import bounded_broadcast, materialise, numbered, small_batches

K, LAMBDA, POOL = 5, 0.7, 4


#: Query vectors that are held against all others at once; of these, and of vectors, those that a task compares in one product.
DENSE_BLOCK = 4096
TILE_QUERIES, TILE_VECTORS = 256, 1024


def scores(questions: DataFrame, postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, score from weights (query_id, term, weight), a materialised table, and postings
    (key, term, weight).  One shuffle, of sums per question and text, where questions are few."""
    q = bounded_broadcast(questions.select("query_id", "term", F.col("weight").alias("qw")))
    both = postings.select(key, "term", "weight").join(q, "term")
    return both.groupBy("query_id", key).agg(F.round(F.sum(F.col("qw") * F.col("weight")), 9).alias("score"))


def top_k(scored: DataFrame, k: int = K, order: str = "doc_id") -> DataFrame:
    """scored with rank, the first k per query."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pad_with_zeros(scored: DataFrame, questions: DataFrame, store: DataFrame, k: int, order: str = "doc_id") -> DataFrame:
    """scored and, with score 0, the first k of the store for each question that has a vector.

    No more can ever be needed among the first k.  The store's part is k rows."""
    first = F.broadcast(store.select(order).orderBy(order).limit(k))
    asked = questions.select("query_id").distinct()
    zeros = asked.crossJoin(first).join(scored, ["query_id", order], "left_anti").withColumn("score", F.lit(0.0))
    return scored.unionByName(zeros)


def without_hits(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Questions whose vector is empty."""
    return questions.join(vectors.select("query_id").distinct(), "query_id", "left_anti")


def pool_similarity(pool: DataFrame, postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, a, b, sim for ranks a < b of each question's pool (a materialised table) that share terms."""
    few = bounded_broadcast(pool.select("query_id", key, "rank"))
    terms = postings.select(key, "term", "weight").join(few, key)
    # a pool is some 20 texts, so that a term has few of them
    by = terms.groupBy("query_id", "term").agg(F.array_sort(F.collect_list(F.struct("rank", "weight"))).alias("held"))
    pairs = F.flatten(
        F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x["rank"].alias("a"), y["rank"].alias("b"), (x["weight"] * y["weight"]).alias("w"))))
    )
    each = by.where(F.size("held") > 1).select("query_id", F.inline(pairs))
    return each.groupBy("query_id", "a", "b").agg(F.round(F.sum("w"), 9).alias("sim"))


def mmr(pool: DataFrame, similarity: DataFrame, k: int = K, lam: float = LAMBDA, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, rank: k of each pool, each time the one with the most of
    lam * score - (1 - lam) * similarity to those chosen; of equals the first in the pool."""
    items = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("key"), "score"))).alias("items"))
    sims = similarity.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "a", "b"), "sim"))).alias("sims"))
    rows = items.join(sims, "query_id", "left").withColumn("sims", F.coalesce("sims", F.create_map().cast("map<string,double>")))

    def step(chosen: Column, _: Column) -> Column:
        left = F.filter("items", lambda i: ~F.array_contains(chosen, i["rank"]))

        def value(i: Column) -> Column:
            near = F.transform(chosen, lambda c: F.coalesce(F.element_at("sims", F.concat_ws(":", F.least(i["rank"], c), F.greatest(i["rank"], c))), F.lit(0.0)))
            most = F.coalesce(F.array_max(near), F.lit(0.0))
            return F.struct(F.round(lam * i["score"] - (1 - lam) * F.greatest(most, F.lit(0.0)), 9).alias("v"), (-i["rank"]).alias("r"))

        best = F.array_max(F.transform(left, value))
        return F.when(best.isNull(), chosen).otherwise(F.concat(chosen, F.array(-best["r"])))

    order = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast("array<int>"), step)
    # a pool of k or fewer stays as it is
    order = F.when(F.size("items") <= k, F.transform("items", lambda i: i["rank"])).otherwise(order)
    picked = rows.select("query_id", "items", F.posexplode(order).alias("pos", "at"))
    item = F.element_at("items", F.col("at"))
    return picked.select("query_id", item["key"].alias(key), item["score"].alias("score"), (F.col("pos") + 1).alias("rank"))


def retrieval_records(hits: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """hits with 4-place scores and previews."""
    texts = store.select("doc_id", preview(F.col(text)).alias("preview"))
    return texts.join(bounded_broadcast(materialise(hits, "hits")), "doc_id").withColumn("score", F.round("score", 4))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, vec_id, score, rank by cosine (4 places) of (query_id, v) and (vec_id, v); another id only.

    The stated queries go against all vectors in blocks of DENSE_BLOCK, which is what the driver and
    each task hold, and similarities in tiles of TILE_QUERIES x TILE_VECTORS; a task gives k per query, so that k per query and task are shuffled.  Vectors
    must not be null or of zeros; of equal scores the smaller vec_id comes first."""
    small_batches(queries.sparkSession)
    placed = materialise(numbered(queries.select("query_id", "v"), [F.col("query_id")], "place"), "queries")
    found = None
    for first in range(0, max(1, placed.count()), DENSE_BLOCK):
        block = placed.where((F.col("place") >= first) & (F.col("place") < first + DENSE_BLOCK)).select("query_id", "v").toArrow().combine_chunks()
        part = _against(block, vectors, k)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, "vec_id")


def _against(block: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    ids = block["query_id"].to_numpy()
    q = np.concatenate([_unit(c) for c in block["v"].chunks]) if len(ids) else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _nearest(*shared.value, batches, k)

    return vectors.select("vec_id", "v").mapInArrow(task, "query_id long, vec_id long, score double")


def _nearest(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """query_id, vec_id, score of the k nearest of the batches for each of the unit vectors q, whose names are ids."""
    score, which = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    for batch in (b for b in batches if b.num_rows):
        names, unit = batch.column("vec_id").to_numpy(), _unit(batch.column("v"))
        for v in range(0, len(names), TILE_VECTORS):
            some = names[v : v + TILE_VECTORS]
            for a in range(0, len(ids), TILE_QUERIES):
                own = slice(a, a + TILE_QUERIES)
                new = np.round(q[own] @ unit[v : v + TILE_VECTORS].T, 4)
                new[ids[own, None] == some] = -np.inf
                _take(score[own], which[own], new, some)
    at, _ = hit = np.nonzero(score > -np.inf)
    return pa.record_batch({"query_id": ids[at], "vec_id": which[hit], "score": score[hit]})


def _take(score: np.ndarray, which: np.ndarray, new: np.ndarray, names: np.ndarray) -> None:
    """Put into score and which, the best of each row so far, those of new (a column per name) that are among them."""
    k = score.shape[1]
    row, col = np.nonzero((new >= score[:, -1:]) & (new > -np.inf))
    if not len(row):
        return
    touched, row = np.unique(row, return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(len(touched)), k), row])
    values = np.concatenate([score[touched].ravel(), new[touched[row], col]])
    ids = np.concatenate([which[touched].ravel(), names[col]])
    order = np.lexsort((ids, -values, rows))
    rows = rows[order]
    best = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
    score[touched], which[touched] = values[best].reshape(-1, k), ids[best].reshape(-1, k)


def dense_pool_similarity(pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, a, b, sim for ranks a < b of each query's pool (query_id, vec_id, rank)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, z: s + z)
    v = vectors.select("vec_id", "v", F.sqrt(dot("v", "v")).alias("norm"))
    side = lambda s: pool.join(v, "vec_id").select("query_id", F.col("rank").alias(s), F.col("v").alias(f"v{s}"), F.col("norm").alias(f"n{s}"))
    both = side("a").join(side("b"), "query_id").where("a < b")
    return both.select("query_id", "a", "b", F.round(dot("va", "vb") / (F.col("na") * F.col("nb")), 4).alias("sim"))


def similar_questions(vectors: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """a, b, score of question pairs with cosine of least or more, over weights (query_id, term, weight)
    of unit length and (term, df).

    Terms go from rare to common.  What a question's last terms can add is at most their length, so
    that two similar questions share one of the terms before: only those propose pairs, which keeps
    common terms out of the join.  Proposed pairs are then scored in full."""
    heads = materialise(heads_of(vectors, df, least), "heads")
    pairs = heads.withColumnRenamed("query_id", "a").join(heads.withColumnRenamed("query_id", "b"), "term").where("a < b").select("a", "b").distinct()
    return scored_pairs(pairs, vectors, vectors, least)


def heads_of(vectors: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """query_id, term: of each question's terms, from rare to common, those that can propose a pair of least."""
    ordered = vectors.join(df.select("term", "df"), "term")
    rest = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(0, W.unboundedFollowing)
    return ordered.withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(rest)).where(F.col("left") >= least * least - 1e-6).select("query_id", "term")


def scored_pairs(pairs: DataFrame, first: DataFrame, second: DataFrame, least: float) -> DataFrame:
    """a, b, score of pairs (a, b) of a question of first and one of second with cosine of least or more."""
    x = first.select(F.col("query_id").alias("a"), "term", F.col("weight").alias("wa"))
    y = second.select(F.col("query_id").alias("b"), "term", F.col("weight").alias("wb"))
    out = pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("score"))
    return out.where(F.col("score") >= least)
