"""Registered queries of these operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, consistent_parsing, content_sort, grid_join, language_id, mixing, ngram_join, packing, periodic_runs, quality, secret_scan, token_alignment, token_rollup
from .scratch import fresh_path, materialise


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.secret_spans(_read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spans_text(F.concat("base", "found")).alias("spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    out = quality.score(docs, weights)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(_read(spark, sf_dir, "documents"), keep="max")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary())


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional counts (a token per four characters) are inserted, revised to exact ones, and
    toxic documents deleted; the second batch comes twice."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    version = F.lit("byte_bpe_50k").alias("version")
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    first = docs.select("doc_id", version, F.lit("insert").alias("op"), "source", "lang", F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).alias("n_tokens"))
    rollup.apply(1, first)
    exact = materialise(token_rollup.count_tokens(docs, vocabulary()), "counts")
    second = exact.select("doc_id", version, F.lit("revise").alias("op"), "source", "lang", "n_tokens")
    rollup.apply(2, second)
    rollup.apply(2, second)
    none = F.lit(None)
    third = labels.where("toxic = 1").select("doc_id", version, F.lit("delete").alias("op"), none.cast("string").alias("source"), none.cast("string").alias("lang"), none.cast("long").alias("n_tokens"))
    rollup.apply(3, third)
    return rollup.totals()


def op8_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.cosine_groups(_read(spark, sf_dir, "embeddings"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_parsing.compare_with_next(_read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(_read(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
    aligned = aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    out = token_alignment.alignment_counts(materialise(aligned, "aligned"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.repeated(_read(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    out = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality, op3_exact_dedup, op4_ngram_join, op5_mixing, op6_packing, op7_token_rollup, op8_grid_join, op9_chunk_dedup, op10_language_id,
        op11_fingerprints, op12_token_alignment, op13_periodic_runs,
    )
}

# the text as compared: null as empty, A-Z alone in lower case
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_NORM}) AS text_sha256, {_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_NORM}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op8_grid_join": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
              WHERE e IS NOT NULL AND list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT c.a AS vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN k ON k.a = c.a""",
}
