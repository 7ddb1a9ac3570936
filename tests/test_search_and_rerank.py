import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS
from corpusloom.operators import chunking, dense, evaluate, grounding, rerank, search, tfidf
from corpusloom.plans.queries import QUERIES
from corpusloom.sources.shared import materialise


def test_weights_have_unit_length(spark):
    d = spark.createDataFrame([(1, "cat dog dog"), (2, "cat"), (3, "the")], "doc_id long, text string")
    c = tfidf.term_counts(d)
    w = tfidf.weights(c, tfidf.inverse_frequency(tfidf.document_frequency(c), d))
    sums = {r.doc_id: r.s for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()}
    assert set(sums) == {1, 2} and all(abs(s - 1) < 1e-9 for s in sums.values())


def test_padding_and_ties(spark):
    store = spark.range(6).withColumnRenamed("id", "doc_id")
    q = spark.createDataFrame([(1, "t", 1.0)], "query_id long, term string, weight double")
    hits = search.scores(q, spark.createDataFrame([(4, "t", 0.5), (2, "t", 0.5)], "doc_id long, term string, weight double"))
    got = search.top_k(search.pad_with_zeros(hits, q, store, 4), 4).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 0.5), (4, 0.5), (0, 0.0), (1, 0.0)]


def plain_mmr(rel, sim, k, lam):
    if len(rel) <= k:
        return list(range(len(rel)))
    out = []
    while len(out) < k:
        best = None
        for i in range(len(rel)):
            if i not in out:
                v = round(lam * rel[i] - (1 - lam) * max([0.0, *(sim.get((min(i, j), max(i, j)), 0.0) for j in out)]), 9)
                if best is None or v > best[0]:
                    best = (v, i)
        out.append(best[1])
    return out


def test_mmr_equals_a_plain_loop(spark):
    rng = random.Random(3)
    pool, sims, want = [], [], {}
    for q in range(40):
        n = rng.choice([3, 5, 6, 20])
        rel = sorted((round(rng.random(), 2) for _ in range(n)), reverse=True)
        sim = {(a, b): round(rng.random(), 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.7}
        pool += [(q, 100 + i, r, i + 1) for i, r in enumerate(rel)]
        sims += [(q, a + 1, b + 1, s) for (a, b), s in sim.items()]
        want[q] = [100 + i for i in plain_mmr(rel, sim, 5, 0.7)]
    got = search.mmr(
        spark.createDataFrame(pool, "query_id long, doc_id long, score double, rank int"), spark.createDataFrame(sims, "query_id long, a int, b int, sim double")
    ).collect()
    found = {q: [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want}
    assert found == want


def test_judgments(spark):
    c = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 1), (2, 2)], "query_id long, doc_id long")
    j = spark.createDataFrame([(1, 5, 2.0, "a", 1), (1, 5, 8.0, "b", 2), (1, 9, 8.0, "c", 1), (2, 2, 9.0, "d", 1)], "query_id long, doc_id long, llm_score double, rationale string, seq int")
    out = rerank.merge_judgments(c, j, spark.createDataFrame([(2,)], "query_id long")).orderBy("query_id", "new_rank").collect()
    assert [(r.doc_id, r.llm_score, r.original_rank) for r in out] == [(5, 8.0, 2), (9, 8.0, 3), (3, 0.0, 1), (1, 5.0, 1), (2, 5.0, 2)]
    assert out[2].rationale == rerank.NO_RATIONALE and out[3].judge_failed
    assert rerank.final_sources(rerank.merge_judgments(c, j), 2).count() == 4


def test_quality_measures(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 8), (1, 9), (2, 5)], "query_id long, doc_id long")
    r = evaluate.summary(evaluate.per_query(hits, rel)).first()
    assert (r.precision_at_k, r.recall_at_k, r.mrr) == (0.25, 0.25, 0.25)


def test_empty_store(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    c = tfidf.term_counts(d)
    assert tfidf.weights(c, tfidf.inverse_frequency(tfidf.document_frequency(c), d)).count() == 0


def test_chunk_search_equals_brute_force(spark, tmp_path):
    """Questions that few or no chunks match are padded, and equal scores rank, in store order."""
    rng = random.Random(5)
    docs = [(i, "cat and mouse" if i in (2, 10) else " ".join(rng.choices(["sun", "moon", "star"], k=4)), "src") for i in range(1, 13)]
    docs += [(13, " ".join(rng.choices(["river", "lake", "sea", "star"], k=700)), None), (14, None, "src")]
    asked = [(1, "cat"), (2, "river lake"), (3, "moon sun sun"), (4, "unheard of"), (5, "the")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tokens = lambda t: Counter(w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1 and w not in STOPWORDS)
    store = []
    for i, text, title in docs:
        full = "\n\n".join(x for x in (title, text or "") if x is not None)
        store += [(f"{i}#chunk-{k}", tokens(full[a:b])) for k, (a, b) in enumerate(chunking.spans(full, chunking.SIZE, chunking.OVERLAP), 1)]
    df = Counter(t for _, c in store for t in c)
    idf = {t: math.log((1 + len(store)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    want = set()
    for q, text in asked:
        if v := unit(tokens(text)):
            scored = [(round(sum(x * unit(c).get(t, 0.0) for t, x in v.items()), 9), -k, name) for k, (name, c) in enumerate(store)]
            want |= {(q, name, round(x, 4), rank) for rank, (x, _, name) in enumerate(sorted(scored, reverse=True)[:5], 1)}
    got = {tuple(r) for r in QUERIES["chunk_search_topk"](spark, str(tmp_path)).select("query_id", "chunk_id", "score", "rank").collect()}
    assert got == want and len(want) == 15 and [n for q, n, _, r in sorted(want, key=lambda x: x[3]) if q == 1] == ["2#chunk-1", "10#chunk-1", "1#chunk-1", "3#chunk-1", "4#chunk-1"]


def test_ranks_of_a_recorded_run(spark):
    """Retrieved in one order, numbered in the store's, ranked by the judge's scores, cut to four."""
    store = ["n#chunk-1", "n#chunk-5", "n#chunk-7", "m#chunk-5", "m#chunk-6"]
    retrieved = [("n#chunk-7", 0.2024), ("n#chunk-1", 0.193), ("m#chunk-6", 0.1131), ("m#chunk-5", 0.1799), ("n#chunk-5", 0.1657)]
    judged = {"n#chunk-1": 9.0, "m#chunk-5": 8.5, "n#chunk-5": 4.0, "n#chunk-7": 3.0, "m#chunk-6": 1.0}
    cand = spark.createDataFrame([(1, store.index(c), c, s) for c, s in retrieved], "query_id long, ord long, chunk_id string, score double")
    j = spark.createDataFrame([(1, store.index(c), s, "why", 1) for c, s in judged.items()], "query_id long, ord long, llm_score double, rationale string, seq int")
    out = rerank.merge_judgments(cand, j, order="ord").orderBy("new_rank").collect()
    assert [(r.chunk_id, r.original_rank, r.new_rank, r.llm_score) for r in out] == [
        ("n#chunk-1", 1, 1, 9.0), ("m#chunk-5", 4, 2, 8.5), ("n#chunk-5", 2, 3, 4.0), ("n#chunk-7", 3, 4, 3.0), ("m#chunk-6", 5, 5, 1.0),
    ]
    final = rerank.final_sources(rerank.merge_judgments(cand, j, order="ord")).withColumn("doc_id", F.substring_index("chunk_id", "#", 1))
    docs = spark.createDataFrame([("n", "T", "A. Writer", 2023, "J")], "doc_id string, title string, authors string, year int, source string")
    cited = grounding.cited_sources(final, docs, zero_score=True).orderBy("position").collect()
    assert [(r.position, r.doc_id, r.authors, r.year, r.source, r.score, r.llm_score) for r in cited] == [
        (1, "n", "A. Writer", 2023, "J", 0.0, 9.0), (2, "m", "Unknown", 0, "", 0.0, 8.5), (3, "n", "A. Writer", 2023, "J", 0.0, 4.0), (4, "n", "A. Writer", 2023, "J", 0.0, 3.0),
    ]


def test_candidates_in_store_order(spark):
    store = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "doc_id long, text string")
    cand = spark.createDataFrame([(1, 7), (1, 2), (2, 7), (2, 99)], "query_id long, doc_id long")
    assert [(r.doc_id, r.place) for r in rerank.candidates_in_store_order(store, cand).orderBy("place").collect()] == [(2, 0), (7, 1)]
    assert rerank.candidates_in_store_order(store, cand.limit(0)).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "DENSE_BLOCK", 3)
    rng = random.Random(8)
    vectors = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(40)} | {40: [1.0] * 6, 41: [2.0] * 6}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<float>").repartition(3)
    asked = [0, 5, 7, 11, 40, 41, 12]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in search.dense_top_k(df.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id"), df, 4).collect()}
    want = {}
    for q in asked:
        best = sorted(((-cos(vectors[q], v), i) for i, v in vectors.items() if i != q))[:4]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-4 for k in want)
    assert search.dense_top_k(df.limit(0).withColumnRenamed("vec_id", "query_id"), df).count() == 0


def test_index_by_cells_equals_all_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    kernels = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = {i: [x + rng.gauss(0, 0.1) for x in kernels[rng.choice([0, 0, 0, *range(12)])]] for i in range(400)}
    vectors |= {400: vectors[0], 401: vectors[0], 402: [0.0] * 8, 403: None, 404: [math.nan] * 8, 405: [None] + [1.0] * 7, 406: [math.inf] * 8}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<double>").repartition(3).cache()
    good, bad = df.where("vec_id < 402"), set(range(402, 407))
    monkeypatch.setattr(dense, "SLICE", 20)
    monkeypatch.setattr(dense, "BLOCK", 7)
    held = dense.build(df, str(tmp_path / "cells"))
    assert sorted(r.vec_id for r in held.vectors.select("vec_id").collect()) == list(range(402))
    assert max(held.slices) > 1  # several slices of a cell, and several blocks of questions below
    asked = df.where("vec_id % 20 = 0 OR vec_id >= 400").withColumnRenamed("vec_id", "query_id")
    rows = lambda found: {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
    best = search.dense_top_k(asked.where("query_id < 402"), good, 6)
    assert rows(held.search(asked, 6, exact=True)) == rows(best)
    assert rows(held.search(asked, 6, probes=1, exact=True)) == rows(best)
    # more than any cell holds: each question meets all
    assert len(rows(held.search(asked.where("query_id = 20"), 500, exact=True))) == 401
    found = held.search(asked, 6)
    assert dense.recall(found, best).first().recall >= 0.9 and not {r.query_id for r in found.collect()} & bad
    assert held.probes < len(held.cells) / 2


def test_index_of_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, v array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, v array<float>")
    held = dense.build(none, str(tmp_path / "none"))
    assert held.search(some.withColumnRenamed("vec_id", "query_id"), exact=True).count() == 0
    held = dense.build(some, str(tmp_path / "one"))
    assert held.search(some.selectExpr("5 AS query_id", "v")).count() == 1
    assert held.search(some.selectExpr("1L AS query_id", "v"), exact=True).count() == 0


def test_similar_questions_equal_all_pairs(spark):
    rng = random.Random(2)
    rows, vec = [], {}
    for q in range(60):
        terms = rng.sample([f"t{k}" for k in range(25)], rng.randint(1, 6)) + ["common"]
        w = {t: rng.random() for t in terms}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vec[q] = {t: x / norm for t, x in w.items()}
        rows += [(q, t, x) for t, x in vec[q].items()]
    df = Counter(t for v in vec.values() for t in v)
    got = {(r.a, r.b) for r in search.similar_questions(spark.createDataFrame(rows, "query_id long, term string, weight double"), spark.createDataFrame(list(df.items()), "term string, df long"), 0.8).collect()}
    want = {(a, b) for a in vec for b in vec if a < b and round(sum(x * vec[b].get(t, 0.0) for t, x in vec[a].items()), 6) >= 0.8}
    assert got == want and want


def test_dense_search_holds_tiles_of_similarities():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[2990:] = x[:10]  # equal vectors: the smaller id first
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids = np.arange(0, 3000, 2)
    batches = [pa.record_batch({"vec_id": np.arange(3000), "v": pa.array(x.tolist())})]
    tracemalloc.start()
    out = search._nearest(ids, x[ids], iter([*batches, batches[0].slice(0, 0)]), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for q, v, s in zip(*(out.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
        got.setdefault(q, []).append((v, s))
    every = np.round(x[ids] @ x.T, 4)
    for row, q in enumerate(ids.tolist()):
        every[row, q] = -np.inf
        want = np.lexsort((np.arange(3000), -every[row]))[:3].tolist()
        assert got[q] == [(v, every[row, v]) for v in want]
    assert peak < 32 << 20  # all similarities at once are 36 MB, and were held several times


def test_few_sources_are_looked_up_without_a_shuffle_of_the_store(spark):
    """By a join whose other side's size Spark doesn't know, the store's whole texts were shuffled."""
    store = materialise(spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 20).alias("content")), "store")
    few = spark.range(3).select(F.col("id").alias("query_id"), (F.col("id") * 400).alias("doc_id"), F.lit(0.5).alias("score")).repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (rerank.lookup_sources(few, store), search.retrieval_records(few, store, "content")):
            assert "BroadcastHashJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Exchange hashpartitioning" not in plan
            assert {(r.query_id, r.doc_id) for r in out.collect()} == {(0, 0), (1, 400), (2, 800)}
        placed = rerank.candidates_in_store_order(store.select("doc_id"), few.union(few))
        assert {(r.doc_id, r.place) for r in placed.collect()} == {(0, 0), (400, 1), (800, 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequencies_of_given_terms_alone(spark):
    d = spark.createDataFrame([("cat dog dog",), ("Cat",), ("the eel",), (None,)], "text string")
    only = materialise(spark.createDataFrame([("cat",), ("the",), ("none",), ("eel",)], "term string"), "only")
    assert {tuple(r) for r in tfidf.frequency_of(d, only=only).collect()} == {("cat", 2), ("eel", 1)}
    assert {tuple(r) for r in tfidf.frequency_of(d).collect()} == {("cat", 2), ("dog", 1), ("eel", 1)}
