"""Queries of ingestion: checks, manifests, texts and corpora, and of run traces.

Uploads, manifests and steps are made from the given tables by rules on the row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import ingest, trace
from corpusloom.plans.registry import query, table
from corpusloom.sources import corpus
from corpusloom.sources.shared import fresh_path


# uploads from documents: names, types and sizes by rules on the row
def _uploads(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("f"), "doc_id", F.when(k == 0, ".exe").when(k == 1, ".md").otherwise(".TXT")).alias("original_filename"),
        F.when(k == 2, "image/png").otherwise("text/plain").alias("mime_type"),
        F.when(k == 3, 0).otherwise(F.col("n_chars") * F.when(k == 4, 10_000).otherwise(1)).alias("size"), F.sha2("text", 256).alias("hash"), F.floor(F.col("doc_id") / 50).alias("batch_id"),
    )


_UP = """u AS (SELECT doc_id AS id, doc_id % 6 AS k, CASE WHEN doc_id % 6 = 3 THEN 0 WHEN doc_id % 6 = 4 THEN n_chars * 10000 ELSE n_chars END AS size, sha256(text) AS hash, doc_id // 50 AS batch_id FROM documents)"""


@query(f"WITH {_UP} SELECT id, CASE WHEN k = 0 THEN 'extension' WHEN k = 2 THEN 'mime' WHEN k = 1 THEN 'mismatch' WHEN size = 0 THEN 'empty' WHEN size > 26214400 THEN 'too_large' END AS error FROM u")
def upload_validation(spark, sf_dir):
    return _uploads(spark, sf_dir).select("id", ingest.upload_error(F.col("original_filename"), F.col("mime_type"), F.col("size")).alias("error"))


@query(f"WITH {_UP} SELECT a.id, b.id AS existing_id FROM u a JOIN (SELECT hash, min(id) AS id FROM u WHERE id % 2 = 0 GROUP BY 1) b ON a.hash = b.hash")
def duplicate_uploads(spark, sf_dir):
    u = _uploads(spark, sf_dir)
    manifest = u.select("id", "hash", F.when(F.col("id") % 2 == 0, "completed").otherwise("failed").alias("processing_status"))
    return ingest.duplicates(u.select(F.col("id"), "hash"), manifest).select("id", "existing_id")


@query(f"""WITH RECURSIVE {_UP}, o AS (SELECT batch_id, id AS pos, size, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS n FROM u),
    r AS (SELECT batch_id, pos, size, n, size <= 200000 AS accepted, CASE WHEN size <= 200000 THEN size ELSE 0 END AS used FROM o WHERE n = 1
          UNION ALL SELECT o.batch_id, o.pos, o.size, o.n, r.used + o.size <= 200000, r.used + CASE WHEN r.used + o.size <= 200000 THEN o.size ELSE 0 END FROM r JOIN o ON o.batch_id = r.batch_id AND o.n = r.n + 1)
    SELECT batch_id, pos, size, accepted FROM r""")
def quota_check(spark, sf_dir):
    u = _uploads(spark, sf_dir).select("batch_id", F.col("id").alias("pos"), "size")
    return ingest.quota_check(u, 0, 200_000).select("batch_id", F.col("pos").cast("long").alias("pos"), "size", "accepted")


@query("SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 20 THEN 'failed' ELSE 'extracted' END AS status FROM documents")
def extraction_status(spark, sf_dir):
    return ingest.extraction_status(table(spark, sf_dir, "documents")).select("doc_id", "status")


_EV = "e AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS status FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("message"), "ts")


@query(f"WITH {_EV} SELECT doc_id, max(seq) AS seq, arg_max(status, seq) AS status FROM e GROUP BY 1")
def manifest_current(spark, sf_dir):
    return ingest.current_manifest(_events(spark, sf_dir)).select("doc_id", "seq", "status")


#: Lifecycles of six events each: every seventh by value has another status, every eleventh an earlier time.
_LIFE = """l AS (SELECT event_id // 6 AS doc_id, event_id AS seq, CASE WHEN floor(value)::BIGINT % 11 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts,
      (['queued', 'extracting', 'chunking', 'embedding', 'completed', 'deleted', 'failed', 'lost'])[CASE WHEN floor(value)::BIGINT % 7 = 0 THEN floor(value * 10)::BIGINT % 8 ELSE event_id % 6 END + 1] AS status FROM events),
    p AS (SELECT *, lag(status) OVER w AS was, lag(ts) OVER w AS before, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    j AS (SELECT doc_id, seq, was, status, CASE WHEN status = 'lost' THEN 'unknown' WHEN ts < before THEN 'out_of_order' WHEN status = was THEN 'repeated'
          WHEN NOT CASE WHEN n = 1 THEN status = 'queued' WHEN was = 'lost' THEN true ELSE was || '>' || status IN ('queued>extracting', 'extracting>chunking', 'extracting>failed', 'chunking>embedding', 'chunking>failed',
               'embedding>completed', 'embedding>failed', 'completed>deleted', 'failed>deleted') END THEN 'illegal' END AS problem FROM p)"""


def _lifecycles(spark, sf_dir):
    value, n = F.floor("value"), F.col("event_id")
    status = F.array(*(F.lit(s) for s in ("queued", "extracting", "chunking", "embedding", "completed", "deleted", "failed", "lost")))
    at = F.when(value % 7 == 0, F.floor(F.col("value") * 10) % 8).otherwise(n % 6).cast("int")
    ts = F.when(value % 11 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select(F.floor(n / 6).alias("doc_id"), n.alias("seq"), F.get(status, at).alias("status"), ts.alias("ts"))


@query(f"WITH {_LIFE} SELECT doc_id, seq, was, status, problem FROM j WHERE problem IS NOT NULL")
def lifecycle_problems(spark, sf_dir):
    return ingest.lifecycle_problems(_lifecycles(spark, sf_dir))


@query("SELECT count(*) FILTER (doc_id % 2 = 0) AS completed, sum(n_chars)::BIGINT AS total_size FROM documents")
def completed_summary(spark, sf_dir):
    return ingest.completed_summary(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "completed").otherwise("failed").alias("processing_status"), F.col("n_chars").alias("size")))


@query("SELECT conv_id, turn, CASE WHEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'missing' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 1000 THEN 'too_long' END AS error FROM conversations WHERE role = 'user'")
def question_validation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.question_error(F.col("text")).alias("error"))


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("agent"), F.round("value", 2).cast("decimal(18,2)").alias("duration_ms"), F.when(F.col("event_id") % 97 == 0, "error").otherwise("completed").alias("status"), F.col("event_id").alias("started_at"), (F.col("event_id") + 5).alias("finished_at"))


@query("WITH s AS (SELECT event_type AS agent, round(value, 2)::DECIMAL(18, 2) AS v FROM events) SELECT agent, count(*) AS n, round(avg(v), 4) AS mean_ms, round(sum(v)::DOUBLE / (SELECT sum(v)::DOUBLE FROM s), 6) AS share FROM s GROUP BY 1")
def step_latency_share(spark, sf_dir):
    out = trace.latency_share(_steps(spark, sf_dir))
    return out.select("agent", "n", F.col("mean_ms").cast("double").alias("mean_ms"), F.col("share").cast("double").alias("share"))


@query("SELECT user_id AS run_id, bool_or(event_id % 97 = 0) AS any_error, count(*) AS n_steps, max(event_id) + 5 - min(event_id) AS total_ms FROM events GROUP BY 1")
def run_errors(spark, sf_dir):
    return trace.run_summary(_steps(spark, sf_dir))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def latest_assistant_turn(spark, sf_dir):
    return trace.latest_turn(table(spark, sf_dir, "conversations"))


_QUOTA = """asked AS (SELECT batch_id, id, size, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS n FROM rules WHERE error IS NULL),
    fold AS (SELECT batch_id, id, size, n, size <= {limit} AS accepted, CASE WHEN size <= {limit} THEN size ELSE 0 END AS used FROM asked WHERE n = 1
          UNION ALL SELECT a.batch_id, a.id, a.size, a.n, f.used + a.size <= {limit}, f.used + CASE WHEN f.used + a.size <= {limit} THEN a.size ELSE 0 END FROM fold f JOIN asked a ON a.batch_id = f.batch_id AND a.n = f.n + 1)"""


@query(f"""WITH RECURSIVE {_UP}, done AS (SELECT hash, min(id) AS id FROM u WHERE id % 4 = 1 GROUP BY 1),
    rules AS (SELECT u.*, d.id AS existing_id, CASE WHEN d.id IS NOT NULL THEN 'duplicate' WHEN k = 0 THEN 'extension' WHEN k = 2 THEN 'mime' WHEN k = 1 THEN 'mismatch' WHEN size = 0 THEN 'empty' WHEN size > 26214400 THEN 'too_large' END AS error FROM u LEFT JOIN done d ON d.hash = u.hash),
    {_QUOTA.format(limit=60000)}
    SELECT r.id, CASE WHEN r.error = 'duplicate' THEN 409 WHEN r.error IS NOT NULL OR NOT f.accepted THEN 400 ELSE 201 END AS code, coalesce(r.error, CASE WHEN NOT f.accepted THEN 'quota' END) AS message, r.existing_id
    FROM rules r LEFT JOIN fold f ON f.id = r.id""")
def upload_results(spark, sf_dir):
    """Requests of 50 files, against a manifest of every fourth document; 60,000 bytes are left to each."""
    u = _uploads(spark, sf_dir)
    manifest = u.where("id % 4 = 1").select("id", "hash", F.lit("completed").alias("processing_status"))
    out = ingest.ingest_results(u.withColumn("pos", F.col("id")), manifest, 0, 60_000)
    return out.select("id", "code", "message", "existing_id")


@query("SELECT doc_id AS id, doc_id < 1000000000 AS found, n_chars FROM (SELECT doc_id, n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, NULL FROM documents)")
def manifest_lookup(spark, sf_dir):
    """Each document's id, and as many that are not there."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return ingest.lookup(d, d.select("id").unionByName(d.select((F.col("id") + 1_000_000_000).alias("id")))).select("id", "found", "n_chars")


@query(f"WITH {_EV}, m AS (SELECT doc_id, arg_max(status, seq) AS status FROM e GROUP BY 1) SELECT coalesce(bool_or(status NOT IN ('completed', 'failed')), false) AS in_flight FROM m")
def in_flight(spark, sf_dir):
    return ingest.in_flight(ingest.current_manifest(_events(spark, sf_dir)))


@query(f"WITH {_EV} SELECT doc_id, max(seq) AS seq, arg_max(status, seq) AS status FROM e WHERE doc_id % 3 <> 0 GROUP BY 1")
def deleted_documents(spark, sf_dir):
    """Every third document is deleted, with ids that are unknown; compacted, the rest remains."""
    e = _events(spark, sf_dir)
    ids = e.select("doc_id").where("doc_id % 3 = 0").unionByName(e.select((F.col("doc_id") + 1_000_000_000).alias("doc_id")))
    return ingest.compact(e.unionByName(ingest.delete_documents(e, ids))).select("doc_id", "seq", "status")


@query("""SELECT doc_id AS id, CASE WHEN ok THEN 'recovered' ELSE 'failed' END AS outcome, sha256(CASE WHEN ok THEN t ELSE '' END) AS sha FROM (SELECT doc_id, t, length(t) >= 20 AND doc_id % 10 <> 0 AS ok
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE doc_id % 2 = 0 AND doc_id % 4 <> 0 OR doc_id % 20 = 10))""")
def recovered_texts(spark, sf_dir):
    """Even documents are completed; those of every fourth have their text, others are read again;
    of every tenth the source is gone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    manifest = d.select("id", F.when(F.col("id") % 2 == 0, "completed").otherwise("failed").alias("processing_status"))
    good, bad = ingest.recover_missing(manifest, d.where("id % 4 = 0"), d.where("id % 10 <> 0"))
    return good.select("id", F.lit("recovered").alias("outcome"), F.sha2("text", 256).alias("sha")).unionByName(bad.select("id", F.col("status").alias("outcome"), F.sha2(F.lit(""), 256).alias("sha")))


@query("SELECT doc_id, sha256(coalesce(text, '') || chr(65533) || 'é') AS decoded, sha256(coalesce(text, '')) AS hash FROM documents")
def decoded_texts(spark, sf_dir):
    """Bytes of each text, with one that is not UTF-8."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    odd = F.concat(raw, F.unhex(F.lit("FF")), F.encode(F.lit("é"), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.decode_text(odd), 256).alias("decoded"), X.content_hash(raw).alias("hash"))


@query("""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord, source AS title, lang AS authors, 2020 AS year, 'bundled' AS source, coalesce(text, '') AS content FROM documents WHERE doc_id % 3 = 0),
    u AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 + (SELECT coalesce(max(doc_ord) + 1, 0) FROM b) AS doc_ord, 'f' || doc_id || '.txt' AS title, 'Uploaded Document' AS authors, 2000 + doc_id % 20 AS year, 'User Upload' AS source,
        regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS content FROM documents WHERE doc_id % 3 = 1)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_ord, title, authors, year, source, sha256(content) AS sha FROM (SELECT * FROM b UNION ALL SELECT * FROM u)""")
def corpus_order(spark, sf_dir):
    """A bundled third and an uploaded third of the documents, written, read again and joined in one
    order; the last third's uploads failed."""
    d, path = table(spark, sf_dir, "documents"), fresh_path(spark, "corpus")
    content = F.coalesce("text", F.lit(""))
    bundled = d.where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("authors"), F.lit(2020).alias("year"), F.lit("bundled").alias("source"), content.alias("content"))
    corpus.write_documents(corpus.in_order(bundled, "doc_id").withColumn("doc_id", F.col("doc_id").cast("string")), f"{path}/bundled")
    up = d.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("id"), X.trim_all(content).alias("text"))
    corpus.write_extracted(up, f"{path}/extracted", 1)
    status = F.when(F.col("id").cast("long") % 3 == 1, "completed").otherwise("failed")
    event = lambda seq, s: up.select(F.col("id").alias("doc_id"), F.lit(seq).cast("long").alias("seq"), s.alias("status"), F.lit(None).cast("string").alias("message"), F.make_timestamp(2000 + F.col("id").cast("int") % 20, F.lit(5), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"))
    corpus.append_events(event(1, F.lit("queued")), f"{path}/events", 1)
    corpus.append_events(event(2, status), f"{path}/events", 2)
    now = ingest.current_manifest(corpus.read_manifest(spark, f"{path}/events"))
    manifest = now.select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("original_filename"), F.col("status").alias("processing_status"), F.col("ts").alias("uploaded_at"))
    uploads = ingest.uploads_as_documents(manifest, corpus.read_extracted(spark, f"{path}/extracted", manifest)).withColumn("n", F.col("doc_id").cast("long"))
    both = corpus.corpus_union(corpus.read_documents(spark, f"{path}/bundled"), corpus.in_order(uploads, "n").drop("n"))
    return both.select("doc_id", "doc_ord", "title", "authors", F.col("year").cast("int").alias("year"), "source", F.sha2("content", 256).alias("sha"))


@query("""SELECT user_id::VARCHAR AS run_id, event_id::VARCHAR AS id, event_type AS agent, event_id AS "startedAt", event_id + 5 AS "finishedAt", 5::BIGINT AS "durationMs", CASE WHEN event_id % 97 = 0 THEN 'error' ELSE 'completed' END AS status,
    '{"k":' || event_id || '}' AS input, '{"n":[1,' || event_id || ']}' AS output FROM events""")
def step_log(spark, sf_dir):
    """Each user's events as one recorded run: nested, written as JSON, read again and laid out."""
    e = table(spark, sf_dir, "events")
    step = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("agent"), F.lit("l").alias("label"), F.col("event_id").alias("startedAt"), (F.col("event_id") + 5).alias("finishedAt"), F.lit(5).alias("durationMs"),
        F.when(F.col("event_id") % 97 == 0, "error").otherwise("completed").alias("status"), F.struct(F.col("event_id").alias("k")).alias("input"), F.struct(F.array(F.lit(1).cast("long"), "event_id").alias("n")).alias("output"),
    )
    path = fresh_path(spark, "runs")
    e.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.collect_list(step).alias("steps")).write.json(path)
    return trace.steps_of(corpus.read_runs(spark, path, per_line=True)).select("run_id", "id", "agent", "startedAt", "finishedAt", "durationMs", "status", "input", "output")
