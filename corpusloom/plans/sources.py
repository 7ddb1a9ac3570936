"""Queries of raw files, of records of mixed shape, and of the library in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import surface
from corpusloom.operators import trace
from corpusloom.plans.registry import TITLED, chunks_sql, query, table, tokens_sql
from corpusloom.sources import corpus, files, semistructured
from corpusloom.sources.shared import fresh_path

#: Documents are bundled by so many to a file; names, contents and bytes vary with their length.
BUNDLE = 16

_FILES = f"""bundle AS (SELECT doc_id // {BUNDLE} AS id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1),
    n AS (SELECT 'f' || id AS id, CASE WHEN length(t) % 11 = 0 THEN '' ELSE t END AS t, length(t) % 11 <> 0 AND length(t) % 3 = 0 AS bad,
          CASE length(t) % 7 WHEN 0 THEN '.exe' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '' ELSE '.TXT' END AS extension FROM bundle),
    f AS (SELECT id, extension, strlen(t) + CASE WHEN bad THEN 1 ELSE 0 END AS size, sha256(CASE WHEN bad THEN encode(t) || '\\xFF'::BLOB ELSE encode(t) END) AS hash,
          CASE WHEN extension IN ('.md', '.TXT') THEN sha256(regexp_replace(t || CASE WHEN bad THEN chr(65533) ELSE '' END, '^\\s+|\\s+$', '', 'g')) END AS text_sha FROM n)"""


def _bundles(spark, sf_dir):
    """name, content, part (0 or 1: when they arrive)."""
    bundle = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / BUNDLE).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("d"))
    t = bundle.select("id", F.array_join("d.text", "\n\n").alias("t")).withColumn("n", F.length("t"))
    kind = F.col("n") % 7
    name = F.concat(F.lit("f"), "id", F.when(kind == 0, ".exe").when(kind == 1, ".md").when(kind == 2, ".pdf").when(kind == 3, "").otherwise(".TXT"))
    raw = F.encode("t", "UTF-8")
    content = F.when(F.col("n") % 11 == 0, F.lit(b"")).when(F.col("n") % 3 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return t.select(name.alias("name"), content.alias("content"), (F.col("id") % 2).alias("part"))


def _with_digest(texts):
    return texts.select("id", "extension", "size", "hash", F.sha2("text", 256).alias("text_sha"))


@query(f"WITH {_FILES} SELECT id, extension, size, hash, text_sha FROM f")
def raw_files(spark, sf_dir):
    """Bundles of documents written as files, some not UTF-8, empty or of other types, and read as bytes."""
    path = fresh_path(spark, "raw")
    written = files.write_files(_bundles(spark, sf_dir), path)
    return _with_digest(files.texts_of(files.read_files(spark, path).unionByName(files.empty_files(written))))


@query(f"WITH {_FILES} SELECT id, extension, size, hash, text_sha FROM f WHERE extension IN ('.md', '.TXT') AND size > 0")
def stream_raw_files(spark, sf_dir):
    """Half of the files, then the other half: a stream of those with bytes whose names match takes in each once."""
    path = fresh_path(spark, "raw")
    for part in range(2):
        files.write_files(_bundles(spark, sf_dir).where(F.col("part") == part), f"{path}/files")
        stream = files.stream_files(spark, f"{path}/files", "*.{md,TXT}")
        files.start_extract(stream, f"{path}/texts", f"{path}/checkpoint").awaitTermination()
    return _with_digest(spark.read.parquet(f"{path}/texts"))


#: Runs of six events each.  An event's type is its agent; the first event's value tells whether the line is whole.
_RUNS = """e AS (SELECT event_id // 6 AS run, event_id, value, floor(value)::BIGINT AS v, event_type, props FROM events),
    r AS (SELECT run, coalesce(max(CASE WHEN event_id % 6 = 0 THEN v END), 9) % 10 AS k FROM e GROUP BY 1)"""


def _write_runs(spark, sf_dir, path):
    """Runs as JSON lines whose steps have different outputs: objects with numbers or text, arrays of items, a text."""
    e = table(spark, sf_dir, "events").withColumn("v", F.floor("value"))
    of = lambda kind: F.col("event_type") == kind
    head = [F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("startedAt"), (F.col("event_id") + F.col("v")).alias("finishedAt")]
    step = lambda agent, output, *more: F.to_json(F.struct(F.lit(agent).alias("agent"), *head, *more, output.alias("output")))
    done = F.lit("completed").alias("status")
    items = F.transform(F.sequence(F.lit(0), (F.col("v") % 4).cast("int")), lambda i: F.struct((F.col("value") + i).alias("score")))
    score = F.when(F.col("v") % 3 == 0, F.struct(F.lit("faithful").alias("verdict"), F.col("v").cast("string").alias("faithfulnessScore")))
    critic = F.when(score.isNotNull(), step("critic", score, done)).otherwise(step("critic", F.struct(F.lit("partial").alias("verdict"), F.col("value").alias("faithfulnessScore")), done))
    steps = (
        F.when(of("view"), step("router", F.struct(F.col("props").alias("queryType"), (F.col("value") > 50).alias("needsRetrieval")), done)).when(of("click"), step("retriever", F.struct(items.alias("candidates")), done))
        .when(of("signup"), critic).when(of("purchase"), step("analyzer", F.struct(F.repeat(F.lit("x"), (F.col("v") % 90).cast("int")).alias("answer")), done)).otherwise(step("retriever", F.lit("timed out"), F.lit("error").alias("status"), F.col("props").alias("error")))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", steps.alias("s")))), lambda x: x["s"])
    first = F.coalesce(F.max(F.when(F.col("event_id") % 6 == 0, F.col("v"))), F.lit(9)) % 10
    runs = e.groupBy(F.floor(F.col("event_id") / 6).alias("run")).agg(F.array_join(ordered, ",").alias("s"), first.alias("k"))
    line, k = F.concat(F.lit('{"run_id":"'), "run", F.lit('","steps":['), "s", F.lit("]}")), F.col("k")
    line = F.when(k == 0, F.substring(line, F.lit(1), F.length(line) - 2)).when(k == 1, F.concat(F.lit('{"run_id":"'), "run", F.lit('","steps":{}}'))).when(k == 2, F.concat(F.lit("["), line, F.lit("]"))).when(k == 3, F.concat(F.lit('{"steps":['), "s", F.lit("]}"))).otherwise(line)
    runs.select(line.alias("value")).write.text(path)


def _runs(spark, sf_dir) -> tuple:
    """The usable runs, and where the others were set aside."""
    path = fresh_path(spark, "run-lines")
    _write_runs(spark, sf_dir, f"{path}/lines")
    read = semistructured.read_run_variants(spark, f"{path}/lines")
    return semistructured.set_aside(read, semistructured.run_problem(F.col("run"), F.col("run_id"), F.col("_corrupt_record")), f"{path}/kept", 1), f"{path}/kept"


@query(f"""WITH {_RUNS} SELECT run::VARCHAR AS run_id, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS pos, event_id::VARCHAR AS id,
    CASE event_type WHEN 'view' THEN 'router' WHEN 'signup' THEN 'critic' WHEN 'purchase' THEN 'analyzer' ELSE 'retriever' END AS agent,
    CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase') THEN 'completed' ELSE 'error' END AS status, v AS took_ms, CASE WHEN event_type = 'error' THEN props END AS error,
    CASE WHEN event_type = 'view' THEN props END AS query_type, CASE WHEN event_type = 'view' THEN value > 50 END AS needs_retrieval,
    CASE WHEN event_type = 'signup' THEN CASE WHEN v % 3 = 0 THEN 'faithful' ELSE 'partial' END END AS verdict, CASE WHEN event_type = 'signup' THEN round(CASE WHEN v % 3 = 0 THEN v ELSE value END, 6) END AS faithfulness,
    CASE WHEN event_type = 'click' THEN v % 4 + 1 END AS n_items, CASE WHEN event_type = 'click' THEN round(value + v % 4, 6) END AS top_score, CASE WHEN event_type = 'purchase' THEN v % 90 END AS answer_length
    FROM e JOIN r USING (run) WHERE k > 3""")
def variant_steps(spark, sf_dir):
    """Steps of recorded runs as VARIANT, and typed fields by agent; runs that can't be used are set aside."""
    typed = trace.typed_steps(trace.variant_steps(_runs(spark, sf_dir)[0]))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return typed.select(
        "run_id", whole("pos"), "id", "agent", "status", (F.col("finished_at") - F.col("started_at")).alias("took_ms"), "error", "query_type", "needs_retrieval", "verdict",
        F.round("faithfulness", 6).alias("faithfulness"), whole("n_items"), F.round("top_score", 6).alias("top_score"), whole("answer_length"),
    )


@query(f"WITH {_RUNS} SELECT CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'no_steps' WHEN 2 THEN 'not_an_object' ELSE 'no_id' END AS problem, count(*) AS n FROM r WHERE k < 4 GROUP BY 1")
def quarantined_runs(spark, sf_dir):
    """How many runs were set aside, by what is wrong with them."""
    return semistructured.aside(spark, _runs(spark, sf_dir)[1], "run variant, _corrupt_record string, run_id string").groupBy("problem").agg(F.count("*").alias("n"))


_LINES = """l AS (SELECT user_id, event_id, event_type, floor(value)::BIGINT % 9 AS k, '{"doc_id":"' || user_id || '","seq":' || CASE WHEN floor(value)::BIGINT % 9 = 1 THEN '"no ' || event_id || '"' ELSE event_id::VARCHAR END || ',"status":"' || event_type || '"' AS line FROM events),
    c AS (SELECT *, CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'wrong_kind' END AS problem FROM l)"""


@query(f"WITH {_LINES} SELECT problem, CASE WHEN problem IS NULL THEN user_id::VARCHAR END AS doc_id, CASE WHEN problem IS NULL THEN event_id END AS seq, CASE WHEN problem IS NULL THEN event_type END AS status, line || CASE WHEN k = 1 THEN '}}' ELSE '' END AS line FROM c WHERE k <= 1 "
       "UNION ALL SELECT problem, user_id::VARCHAR, event_id, event_type, NULL FROM c WHERE k > 1")  # fmt: skip
def quarantined_events(spark, sf_dir):
    """A manifest of JSON lines, of which some are cut off and some have a number of another kind: the
    events, and the lines that were set aside."""
    path, k = fresh_path(spark, "manifest"), F.floor("value") % 9
    seq = F.when(k == 1, F.concat(F.lit('"no '), "event_id", F.lit('"'))).otherwise(F.col("event_id").cast("string"))
    line = F.concat(F.lit('{"doc_id":"'), "user_id", F.lit('","seq":'), seq, F.lit(',"status":"'), "event_type", F.lit('"'), F.when(k == 0, "").otherwise("}"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(f"{path}/lines")
    good = semistructured.set_aside(corpus.read_manifest(spark, f"{path}/lines"), semistructured.event_problem(), f"{path}/kept", 1)
    bad = semistructured.aside(spark, f"{path}/kept", f"{corpus.EVENT}, _corrupt_record string")
    none = lambda kind: F.lit(None).cast(kind)
    return good.select(none("string").alias("problem"), "doc_id", "seq", "status", none("string").alias("line")).unionByName(
        bad.select("problem", none("string").alias("doc_id"), none("bigint").alias("seq"), none("string").alias("status"), F.col("_corrupt_record").alias("line"))
    )


@query(f"WITH {TITLED}, {chunks_sql('titled')} SELECT doc_id, k AS chunk_index, lo AS start_offset, content FROM ck")
def sql_chunks(spark, sf_dir):
    """chunk_documents as SQL text: the chunker is a table function, joined LATERAL."""
    surface.register(spark)
    return spark.sql(
        "SELECT doc_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(c.start_offset AS BIGINT) AS start_offset, text_trim(c.content) AS content "
        "FROM {documents}, LATERAL chunks(concat_ws('\n\n', source, coalesce(text, ''))) c", documents=table(spark, sf_dir, "documents"),
    )


_BLANK = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT conv_id, turn, array_to_string({tokens_sql('text')}, ' ') AS tokens, sha256({_BLANK}) AS sha, CASE WHEN {_BLANK} = '' THEN 'missing' WHEN length({_BLANK}) > 1000 THEN 'too_long' END AS error,
    len(list_distinct(regexp_extract_all('[' || length(coalesce(text, '')) % 4 || '] ' || coalesce(text, '') || ' [2] [2, 3]', '\\[(\\d+)\\]', 1))) AS citations,
    CASE WHEN length(text) % 11 >= 9 THEN 'direct' WHEN length(text) % 11 >= 7 THEN 'strong' WHEN length(text) % 11 >= 4 THEN 'partial' WHEN length(text) % 11 >= 1 THEN 'weak' ELSE 'none' END AS band,
    regexp_replace(regexp_replace(substr(coalesce(text, ''), 1, 160), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') || CASE WHEN length(text) > 160 THEN '…' ELSE '' END AS preview FROM conversations""")
def sql_functions(spark, sf_dir):
    """The text functions in SQL text, over all turns."""
    surface.register(spark)
    return spark.sql(
        "SELECT conv_id, turn, array_join(text_tokens(text), ' ') AS tokens, sha2(text_trim(coalesce(text, '')), 256) AS sha, question_error(text) AS error, "
        "CAST(citation_count(concat('[', length(coalesce(text, '')) % 4, '] ', coalesce(text, ''), ' [2] [2, 3]')) AS BIGINT) AS citations, "
        "relevance_band(length(text) % 11) AS band, text_excerpt(coalesce(text, ''), 160) AS preview FROM {turns}", turns=table(spark, sf_dir, "conversations"),
    )
