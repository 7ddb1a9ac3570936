"""Queries of streaming ingestion: the documents as uploads, in a stream of several arrivals, then some deleted."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import chunks_sql, hits_sql, query, stored, table, tokens_sql
from corpusloom.sources import corpus
from corpusloom.sources.shared import ROW_GROUP, fresh_path
from corpusloom.streaming import ingest as stream

#: An owner's quota in bytes, of some 250,000 that its hundred files have on average; what comes in at once.
LIMIT, ARRIVALS = 300_000, 4

_STREAMED = f"""
    u AS (SELECT doc_id AS id, doc_id // 100 AS owner, doc_id % 20 AS k, 'f' || doc_id || CASE doc_id % 20 WHEN 0 THEN '.exe' WHEN 1 THEN '.md' ELSE '.TXT' END AS title, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text,
          sha256(coalesce(text, '')) AS hash, CASE WHEN doc_id % 20 = 3 THEN 0 ELSE strlen(coalesce(text, '')) END AS size FROM documents),
    rules AS (SELECT *, length(text) >= 20 AS good, CASE WHEN k = 0 THEN 'extension' WHEN k = 2 THEN 'mime' WHEN k = 1 THEN 'mismatch' WHEN size = 0 THEN 'empty' WHEN size > 26214400 THEN 'too_large' END AS error FROM u),
    firsts AS (SELECT *, min(id) FILTER (error IS NULL AND good) OVER (PARTITION BY owner, hash) AS first FROM rules),
    queue AS (SELECT owner, list({{'id': id, 'size': size}} ORDER BY id) AS q FROM firsts WHERE error IS NULL AND (NOT good OR first = id) GROUP BY 1),
    quota AS (SELECT list_reduce(q, lambda a, x: CASE WHEN a.size + x.size <= {LIMIT} THEN {{'id': 0::BIGINT, 'size': a.size + x.size, 'ok': list_append(a.ok, x.id)}} ELSE a END, {{'id': 0::BIGINT, 'size': 0::BIGINT, 'ok': []::BIGINT[]}}).ok AS ok FROM queue),
    fits AS (SELECT unnest(ok) AS id FROM quota),
    judged AS (SELECT f.*, own.id IS NOT NULL AS accepted, came.id IS NOT NULL AND f.id > f.first AS copy FROM firsts f LEFT JOIN fits own ON own.id = f.id LEFT JOIN fits came ON came.id = f.first),
    results AS (SELECT id, title, text, CASE WHEN copy THEN 409 WHEN error IS NOT NULL OR NOT accepted THEN 400 ELSE 201 END AS code,
        CASE WHEN copy THEN 'duplicate' WHEN error IS NOT NULL THEN error WHEN NOT accepted THEN 'quota' END AS message, CASE WHEN copy THEN first END AS existing_id FROM judged),
    kept AS (SELECT * FROM results WHERE code = 201 AND length(text) >= 20 AND id % 10 <> 5)"""


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """State after all documents came as uploads, in ARRIVALS parts, and every tenth was deleted."""

    def make(path: str) -> None:
        docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 20
        uploads = docs.select(
            F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 100).alias("owner"), "text", F.concat(F.lit("f"), "doc_id", F.when(k == 0, ".exe").when(k == 1, ".md").otherwise(".TXT")).alias("original_filename"),
            F.when(k == 2, "image/png").otherwise("text/plain").alias("mime_type"), F.when(k == 3, 0).otherwise(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("size"),
        )
        last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
        ends = [-(-part * last // ARRIVALS) for part in range(ARRIVALS + 1)]
        for part, (lo, hi) in enumerate(zip(ends, ends[1:])):
            # bounds of the table's own column, by which its row groups are passed over
            uploads.where((F.col("id") >= lo) & (F.col("id") < hi)).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/uploads/part-{part}")
            source = spark.readStream.schema(uploads.schema).parquet(f"{path}/uploads/part-*")
            stream.start_ingest(source, f"{path}/state", f"{path}/checkpoint", LIMIT).awaitTermination()
        stream.delete(spark, f"{path}/state", docs.where("doc_id % 10 = 5").select(F.col("doc_id").alias("id")), 1)

    return f"{stored(spark, sf_dir, ('documents',), 'stream', make)}/state"


@query(f"WITH {_STREAMED} SELECT id, code, message, existing_id FROM results")
def stream_ingest_results(spark, sf_dir):
    return stream.read_state(spark, _streamed(spark, sf_dir), "results").select("id", "code", "message", "existing_id")


@query(f"WITH {_STREAMED} SELECT id, title, sha256(text) AS sha FROM kept")
def stream_ingest_dedup(spark, sf_dir):
    """Documents that are there: no copies, none that failed, none deleted."""
    return stream.documents(spark, _streamed(spark, sf_dir)).select("id", "title", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_STREAMED}, s AS (SELECT CASE WHEN length(text) >= 20 THEN 'completed' ELSE 'failed' END AS status FROM results WHERE code = 201 AND id % 10 <> 5) SELECT status, count(*) AS n FROM s GROUP BY 1")
def stream_status_counts(spark, sf_dir):
    """By a streaming aggregate over the lifecycle events."""
    path = fresh_path(spark, "status")
    stream.start_status_counts(spark, _streamed(spark, sf_dir), f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return stream.status_counts(spark, f"{path}/counts")


_CHUNKED = f"{_STREAMED}, titled AS (SELECT id AS doc_id, title || chr(10) || chr(10) || text AS t FROM kept), {chunks_sql('titled')}"


@query(f"WITH {_CHUNKED} SELECT doc_id || '#chunk-' || k AS chunk_id, sha256(content) AS sha FROM ck")
def stream_chunks(spark, sf_dir):
    state = _streamed(spark, sf_dir)
    there = stream.documents(spark, state).select("id")
    return stream.read_state(spark, state, "chunks").join(there, "id", "left_semi").select("chunk_id", F.sha2("content", 256).alias("sha"))


@query(f"""WITH {_CHUNKED}, tok AS (SELECT DISTINCT doc_id, k, unnest({tokens_sql('content')}) AS term FROM ck)
    SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM ck)) / (1 + count(*))) + 1, 9) AS idf FROM tok GROUP BY 1""")
def stream_df_delta(spark, sf_dir):
    """Sums of signed deltas: what a rebuild over the chunks that are there would count."""
    return stream.chunk_index(spark, _streamed(spark, sf_dir)).vocab.select("term", "df", F.round("idf", 9).alias("idf"))


_STORE = f"{_CHUNKED}, store AS (SELECT doc_id * {corpus.CHUNKS} + k AS ord, doc_id || '#chunk-' || k AS chunk_id, content AS text FROM ck)"


@query(f"WITH {_STORE}, {hits_sql('store', 'ord')} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM ranked r JOIN store ON store.ord = r.doc_id WHERE rank <= 5")
def stream_search_topk(spark, sf_dir):
    """Over the index as the stream and the deletion left it: a segment for each part that came, and the dead."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return stream.search(spark, _streamed(spark, sf_dir), questions).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
