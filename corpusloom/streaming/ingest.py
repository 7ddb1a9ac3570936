"""Incremental ingestion with Structured Streaming.

State is a folder of tables, each with a folder per batch (a micro-batch or a deletion): results (one
row per upload), documents, chunks and events (the documents' lifecycle); and the index of the chunks
(see operators.index), to which each batch adds a segment of its own.  Events are written last: a batch
without them doesn't count, and one that is tried again replaces its files, or finds that the index
has it, so that each counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import trim_all
from corpusloom.operators import chunking, index, ingest
from corpusloom.operators import search as similar
from corpusloom.sources import corpus
from corpusloom.sources.shared import ROW_GROUP, bounded_broadcast, discard, materialise, small_table

TABLES = {
    "results": "id long, owner long, hash string, size long, code int, message string, existing_id long, b string",
    "documents": "id long, owner long, hash string, size long, title string, text string, b string",
    "chunks": "id long, ord long, chunk_id string, chunk_index int, content string, b string",
    "events": "id long, seq long, status string, was string, message string, b string",
}
#: Events of one batch have numbers from its own times STEPS on.
STEPS = 16
#: Segments of the index that a search may find; more are made one.
SEGMENTS = 8
STAGES = ("queued", "extracting", "chunking", "embedding", "completed")


def read_state(spark: SparkSession, state: str, table: str) -> DataFrame:
    """A table's rows of all batches that count; empty where there are none."""
    events = _read(spark, state, "events")
    if table == "events":
        return events
    return _read(spark, state, table).join(F.broadcast(events.select("b").distinct()), "b", "left_semi")


def _read(spark: SparkSession, state: str, table: str) -> DataFrame:
    try:
        return spark.read.schema(TABLES[table]).parquet(f"{state}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return small_table(spark, [], TABLES[table])


def _write(rows: DataFrame, state: str, table: str, batch: str) -> DataFrame:
    """Write a batch's rows and return them as written."""
    path = f"{state}/{table}/b={batch}"
    rows.write.mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def current(spark: SparkSession, state: str, leave_out: str = "") -> DataFrame:
    """id, seq, status, message: the latest event of each document that is not deleted."""
    events = read_state(spark, state, "events").where(F.col("b") != leave_out).withColumnRenamed("id", "doc_id")
    latest = ingest.current_manifest(events.withColumn("ts", F.lit(None).cast("timestamp")))
    return latest.select(F.col("doc_id").alias("id"), "seq", "status", "message")


def documents(spark: SparkSession, state: str, leave_out: str = "") -> DataFrame:
    """id, owner, hash, size, title, text of the documents that are there."""
    there = current(spark, state, leave_out).where("status = 'completed'").select("id")
    return read_state(spark, state, "documents").where(F.col("b") != leave_out).drop("b").join(there, "id", "left_semi")


def chunk_index(spark: SparkSession, state: str) -> index.Index:
    """The index of the chunks that are there, by ord; of forward vectors alone, since postings take more room than the chunks."""
    return index.Index(spark, f"{state}/index", "ord", postings=False)


def start_ingest(stream: DataFrame, state: str, checkpoint: str, limit: int = ingest.MAX_TOTAL):
    """Ingests what is there (availableNow) of a stream of uploads (id long, text, original_filename,
    mime_type, size, and owner long where there is more than one), in micro-batches as the source bounds them.

    Files are judged one after the other in order of id (see ingest.judged_uploads): copies after the
    quota, which each owner has of its own.  Accepted texts are trimmed, then cut to chunks, which the index
    takes in; short ones fail.  A null text is empty."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        name = f"{number}"
        owner = F.col("owner") if "owner" in batch.columns else F.lit(0)
        text = trim_all(F.coalesce("text", F.lit("")))
        uploads = batch.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("text", text).withColumn("owner", owner.cast("long"))
        uploads = materialise(uploads.withColumn("good", F.length("text") >= ingest.MIN_TEXT), "uploads", texts=True)
        there = materialise(documents(spark, state, name).select("id", "owner", "hash", "size"), "there")
        known = there.groupBy("owner", "hash").agg(F.min("id").alias("old"))
        used = there.groupBy(F.col("owner").alias("batch_id")).agg(F.sum("size").alias("used"))
        judged = uploads.join(ingest.judged_uploads(uploads, known, used, limit), "id")
        every = _write(judged.select("id", "owner", "hash", "size", "code", "message", "existing_id"), state, "results", name)
        # few bytes a file: texts stay where they are
        taken = uploads.join(bounded_broadcast(every.where("code = 201").select("id")), "id", "left_semi")
        good = _write(taken.where("good").select("id", "owner", "hash", "size", F.col("original_filename").alias("title"), "text"), state, "documents", name)
        pieces = chunking.chunk_documents(good.select(F.col("id").alias("doc_id"), "title", F.col("text").alias("content")), enrich=True)
        ord_ = (F.col("doc_id") * corpus.CHUNKS + F.col("chunk_index")).alias("ord")
        pieces = _write(pieces.select(F.col("doc_id").alias("id"), ord_, "chunk_id", "chunk_index", "content"), state, "chunks", name)
        held = chunk_index(spark, state)
        held.add(pieces, name, "content")
        if len(held.segments) > SEGMENTS:
            held.compact(f"compact-{name}")
        # failed documents stop after extracting
        each = taken.select("id", F.explode(F.when(F.col("good"), _steps(*STAGES)).otherwise(_steps(*STAGES[:2], "failed"))).alias("e"))
        message = F.when(F.col("e.status") == "failed", "too little text")
        _write(each.select("id", (F.lit(number * STEPS) + F.col("e.k")).cast("long").alias("seq"), "e.status", "e.was", message.alias("message")), state, "events", name)
        discard(uploads, there)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _steps(*stages: str) -> Column:
    """An array of the stages with their numbers and what each comes after."""
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("status"), F.lit(was).cast("string").alias("was")) for k, (s, was) in enumerate(zip(stages, (None, *stages)))))


def delete(spark: SparkSession, state: str, ids: DataFrame, number: int) -> None:
    """Delete the documents of ids (id): the index loses their chunks, then they are marked.

    Unknown ids change nothing.  number tells deletions apart; one that is tried again under its
    number replaces what it wrote."""
    name = f"delete-{number}"
    gone = materialise(current(spark, state, name).join(ids.select("id").distinct(), "id", "left_semi"), "gone")
    done = gone.where("status = 'completed'").select("id")
    pieces = read_state(spark, state, "chunks").join(done, "id", "left_semi")
    chunk_index(spark, state).delete(pieces.select(F.col("ord").alias("key")), name)
    events = gone.select("id", (F.col("seq") + 1).alias("seq"), F.lit("deleted").alias("status"), F.col("status").alias("was"), F.lit(None).cast("string").alias("message"))
    _write(events, state, "events", name)


def search(spark: SparkSession, state: str, questions: DataFrame, k: int = similar.K) -> DataFrame:
    """query_id, ord, chunk_id, score, rank: the k best chunks that are there for questions (query_id, question)."""
    held, chunks = chunk_index(spark, state), read_state(spark, state, "chunks")
    there = chunks.join(documents(spark, state).select("id"), "id", "left_semi").select("ord", "chunk_id")
    asked = held.weights_of(questions)
    hits = materialise(similar.top_k(similar.pad_with_zeros(held.search(asked, k), asked, there, k, "ord"), k, "ord"), "hits")
    return there.join(bounded_broadcast(hits), "ord")


def start_status_counts(spark: SparkSession, state: str, out: str, checkpoint: str):
    """Follows the events (availableNow) and writes to out the number of documents of each status that
    has changed (status, n), a folder per micro-batch (b).

    An event names the status that it ends, so that counts are sums of plus and minus one, kept by a
    streaming aggregate of as many keys as there are statuses, in update mode."""
    events = spark.readStream.schema(TABLES["events"]).parquet(f"{state}/events")
    moves = events.select(F.explode(F.array(F.struct("status", F.lit(1).alias("d")), F.struct(F.col("was").alias("status"), F.lit(-1).alias("d")))).alias("m"))
    counts = moves.select("m.*").where("status IS NOT NULL").groupBy("status").agg(F.sum("d").alias("n"))

    def keep(changed: DataFrame, number: int) -> None:
        changed.coalesce(1).write.mode("overwrite").parquet(f"{out}/b={number}")

    return counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(spark: SparkSession, out: str) -> DataFrame:
    """status, n of what start_status_counts has written; deleted documents don't count."""
    rows = spark.read.schema("status string, n long, b long").parquet(out)
    return rows.where("status <> 'deleted'").groupBy("status").agg(F.max_by("n", "b").alias("n")).where("n > 0")
