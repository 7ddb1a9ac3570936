"""Document ingestion as tables: checks, duplicates, quota, lifecycle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import UPLOAD_TYPES, extension, trim_all
from corpusloom.sources.shared import materialise

MAX_FILE, MAX_TOTAL, MIN_TEXT = 25 * 1024 * 1024, 500 * 1024 * 1024, 20
TERMINAL = ("completed", "failed")


def upload_error(name: Column, mime: Column, size: Column) -> Column:
    """First rule that fails (quota comes after, see quota_check), or null."""
    ext = extension(name)
    of = F.create_map(*(F.lit(x) for kv in UPLOAD_TYPES.items() for x in kv))
    return (
        F.when(~F.coalesce(ext, F.lit("")).isin(*UPLOAD_TYPES.values()), "extension")
        .when(~F.coalesce(mime, F.lit("")).isin(*UPLOAD_TYPES), "mime")
        .when(F.element_at(of, mime) != ext, "mismatch")
        .when(size == 0, "empty")
        .when(size > MAX_FILE, "too_large")
    )


#: Files of a batch that one task folds in order; larger batches are brought below it in rounds.
FOLD = 10_000


def quota_check(uploads: DataFrame, used: int | DataFrame = 0, limit: int = MAX_TOTAL, fold: int = FOLD) -> DataFrame:
    """batch_id, pos, size, accepted: in order of pos, which tells a batch's files apart, a file counts only if it fits.

    used: what is taken before, one number or (batch_id, used) rows; null sizes count as 0.  Whether a file fits
    depends on which before it did, so a batch of at most fold files is folded by one task.  Of a larger
    one each round takes the longest beginning that fits, by sums over ranges of its files, and
    refuses those that are larger than what is left then: the next file among them at least."""
    spark, kind = uploads.sparkSession, dict(uploads.dtypes)["batch_id"]
    rows = uploads.select("batch_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    room = F.lit(limit) - (F.lit(used) if isinstance(used, int) else F.coalesce("used", F.lit(0)))
    sums = rows.groupBy("batch_id").agg(F.count("*").alias("files"))
    sums = (sums if isinstance(used, int) else sums.join(used, "batch_id", "left")).select("batch_id", "files", room.cast("long").alias("room"))
    batches, ranges = materialise(sums, "batches"), None
    decided: list[DataFrame] = []
    open_ = rows.join(batches.select("batch_id", "room"), "batch_id")
    while batches.where(F.col("files") > fold).limit(1).count():
        if ranges is None:  # a batch's files in order, cut to ranges that no task has to see together
            large = open_.join(batches.where(F.col("files") > fold).select("batch_id"), "batch_id", "left_semi")
            ranges = materialise(large.repartitionByRange("batch_id", "pos").withColumn("_range", F.spark_partition_id()), "ranges")
            open_ = open_.join(batches.where(F.col("files") > fold).select("batch_id"), "batch_id", "left_anti")
            decided.append(_folded(open_, kind))
        by_range = ranges.groupBy("batch_id", "_range").agg(F.sum("size").alias("sum"))
        before = by_range.withColumn("before", F.coalesce(F.sum("sum").over(W.partitionBy("batch_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("sum")
        running = F.col("before") + F.sum("size").over(W.partitionBy("batch_id", "_range").orderBy("pos"))
        placed = materialise(ranges.join(before, ["batch_id", "_range"]).withColumn("sum", running).drop("before"), "placed")
        stop = placed.where("sum > room").groupBy("batch_id").agg(F.min("pos").alias("stop"))
        placed = placed.join(stop, "batch_id", "left")
        fits = F.col("stop").isNull() | (F.col("pos") < F.col("stop"))
        taken = placed.where(fits).groupBy("batch_id").agg(F.sum("size").alias("taken"))
        placed = placed.join(taken, "batch_id", "left").withColumn("room", F.col("room") - F.coalesce("taken", F.lit(0)))
        judged = placed.select("batch_id", "pos", "size", "room", "_range", F.when(fits, True).when(F.col("size") > F.col("room"), False).alias("accepted"))
        judged = materialise(judged, "judged")
        decided.append(judged.where("accepted IS NOT NULL").select("batch_id", "pos", "size", "accepted"))
        ranges = judged.where("accepted IS NULL").drop("accepted")
        batches = ranges.groupBy("batch_id").agg(F.count("*").alias("files"))
        open_ = ranges.drop("_range")
    decided.append(_folded(open_, kind))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def _folded(rows: DataFrame, kind: str) -> DataFrame:
    """batch_id, pos, size, accepted of (batch_id, pos, size, room), each batch in one task, which goes through its
    batches in order: they are many and small, so that a frame for each would take longer than they do."""

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = (), 0  # no batch yet
        for part in parts:
            fits = []
            for batch, size, room in zip(*(part.column(c).to_pylist() for c in ("batch_id", "size", "room"))):
                if batch != now:
                    now, left = batch, room
                fits.append(size <= left)
                left -= size if fits[-1] else 0
            yield pa.record_batch([*(part.column(c) for c in ("batch_id", "pos", "size")), pa.array(fits, pa.bool_())], names=["batch_id", "pos", "size", "accepted"])

    dealt = rows.select("batch_id", "pos", "size", "room").repartition("batch_id").sortWithinPartitions("batch_id", "pos")
    return dealt.mapInArrow(fold, f"batch_id {kind}, pos long, size long, accepted boolean")


def duplicates(uploads: DataFrame, manifest: DataFrame) -> DataFrame:
    """uploads (with hash) that equal a completed entry: with existing_id."""
    done = manifest.where("processing_status = 'completed'").groupBy("hash").agg(F.min("id").alias("existing_id"))
    return uploads.join(done, "hash")


def fresh(uploads: DataFrame, manifest: DataFrame) -> DataFrame:
    """uploads that no completed entry equals, one of each hash (the first by id)."""
    first = F.row_number().over(W.partitionBy("hash").orderBy("id"))
    left = uploads.join(manifest.where("processing_status = 'completed'").select("hash"), "hash", "left_anti")
    return left.withColumn("_n", first).where("_n = 1").drop("_n")


def judged_uploads(uploads: DataFrame, known: DataFrame, used: DataFrame, limit: int = MAX_TOTAL) -> DataFrame:
    """id, code, message, existing_id of uploads (id, owner, hash, original_filename, mime_type, size, good; materialised), as
    one file after the other in order of id would be judged, each owner's files among themselves.

    known: (owner, hash, old) of completed files; used: (batch_id, used), what owners have taken.  good: the
    file would be completed once accepted.  A file that equals a completed one, or one accepted before it that is good, is 409; one
    that fails a rule is 400, one that doesn't fit the quota too; others are 201.  A copy of a refused file is
    judged for itself.  (Equal files have equal sizes, so that a copy of one that did not fit doesn't fit either: the
    first of a hash decides, and only firsts go through the quota.)"""
    err = upload_error(F.col("original_filename"), F.col("mime_type"), F.col("size"))
    # several branches read these: rules are tried once
    rows = materialise(uploads.select("id", "owner", "hash", "size", "good", err.alias("error")).join(known, ["owner", "hash"], "left"), "rules")
    able = F.col("error").isNull() & F.col("old").isNull()
    firsts = rows.where(able & F.col("good")).groupBy("owner", "hash").agg(F.min("id").alias("first"))
    rows = rows.join(firsts, ["owner", "hash"], "left")
    asks = rows.where(able & (~F.col("good") | (F.col("id") == F.col("first"))))
    fits = materialise(quota_check(asks.select(F.col("owner").alias("batch_id"), F.col("id").alias("pos"), "size"), used, limit).select(F.col("pos").alias("id"), "accepted"), "fits")
    rows = rows.join(fits, "id", "left").join(fits.select(F.col("id").alias("first"), F.col("accepted").alias("came_in")), "first", "left")
    copy = F.coalesce(F.col("came_in") & (F.col("id") > F.col("first")), F.lit(False))
    existing = F.coalesce("old", F.when(copy, F.col("first")))
    message = F.when(existing.isNotNull(), "duplicate").otherwise(F.coalesce("error", F.when(~F.coalesce("accepted", F.lit(False)), "quota")))
    code = F.when(existing.isNotNull(), 409).when(message.isNotNull(), 400).otherwise(201)
    return rows.select("id", code.alias("code"), message.alias("message"), existing.alias("existing_id"))


def ingest_results(uploads: DataFrame, manifest: DataFrame, used: int = 0, limit: int = MAX_TOTAL) -> DataFrame:
    """uploads (batch_id, pos, id, hash, original_filename, mime_type, size, ...) with code, message, existing_id.

    A file that equals a completed one is 409; one that fails a rule is 400, the quota last, for
    which only the files of its batch count that passed all before; else 201.  Null hashes equal
    nothing."""
    done = manifest.where("processing_status = 'completed'").groupBy("hash").agg(F.min("id").alias("existing_id"))
    err = upload_error(F.col("original_filename"), F.col("mime_type"), F.col("size"))
    rows = uploads.join(done, "hash", "left").withColumn("error", F.when(F.col("existing_id").isNull(), err))
    asks = rows.where("existing_id IS NULL AND error IS NULL").select("batch_id", "pos", "size")
    fits = quota_check(asks, used, limit).select("batch_id", "pos", "accepted")
    rows = rows.join(fits, ["batch_id", "pos"], "left")
    message = F.when(F.col("existing_id").isNotNull(), "duplicate").otherwise(F.coalesce("error", F.when(~F.col("accepted"), "quota")))
    code = F.when(F.col("existing_id").isNotNull(), 409).when(message.isNotNull(), 400).otherwise(201)
    return rows.select(*uploads.columns, code.alias("code"), message.alias("message"), "existing_id")


def extraction_status(texts: DataFrame) -> DataFrame:
    """doc_id, status, text: trimmed; under 20 characters is failed."""
    t = trim_all(F.coalesce("text", F.lit("")))
    return texts.select("doc_id", F.when(F.length(t) < MIN_TEXT, "failed").otherwise("extracted").alias("status"), t.alias("text"))


def current_manifest(events: DataFrame) -> DataFrame:
    """Latest lifecycle event (doc_id, seq, status, message, ts) per document; deleted ones go."""
    latest = events.groupBy("doc_id").agg(F.max_by(F.struct("status", "message", "ts"), "seq").alias("e"), F.max("seq").alias("seq"))
    return latest.select("doc_id", "seq", "e.*").where("status <> 'deleted'")


def delete_documents(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstone events for ids; unknown ones give none."""
    known = current_manifest(events).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return known.select("doc_id", (F.col("seq") + 1).alias("seq"), F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("message"), F.current_timestamp().alias("ts"))


def compact(events: DataFrame) -> DataFrame:
    """Only the latest event of documents that remain."""
    return current_manifest(events).select("doc_id", "seq", "status", "message", "ts")


#: What a document's first event may be, and what may follow each.
FLOW = {
    None: ("queued",), "queued": ("extracting",), "extracting": ("chunking", "failed"), "chunking": ("embedding", "failed"),
    "embedding": ("completed", "failed"), "completed": ("deleted",), "failed": ("deleted",), "deleted": (),
}


def lifecycle_problems(events: DataFrame) -> DataFrame:
    """doc_id, seq, was, status, problem of events (doc_id, seq, status, ts) that can't come where they come.

    In order of seq (of equals by ts, then status), by the first that holds: unknown (no status of FLOW, null
    too), out_of_order (earlier than the event before), repeated (the same status again), illegal (not what
    FLOW lets follow).  was: the status before, null at first; what follows an unknown status is judged by
    repetition and time only.  Null doc_ids are one document.

    Events are sorted in ranges, and the first of a range sees the last of the one before, so that a
    document of very many events is not one task's."""
    by = ("doc_id", "seq", "ts", "status")
    ranged = materialise(events.select(*by).repartitionByRange("doc_id", "seq").withColumn("_part", F.spark_partition_id()), "lifecycles")
    ends = ranged.groupBy("_part").agg(F.max(F.struct(*by)).alias("_end"))
    ends = ends.select(F.lead("_part").over(W.orderBy("_part")).alias("_part"), "_end").where("_part IS NOT NULL")  # a row per range
    order = W.partitionBy("_part", "doc_id").orderBy("seq", "ts", "status")
    rows = ranged.withColumn("_last", F.lag(F.struct("status", "ts")).over(order)).join(F.broadcast(ends), "_part", "left")
    carried = F.when(F.col("_end.doc_id").eqNullSafe(F.col("doc_id")) & F.col("_end").isNotNull(), F.struct("_end.status", "_end.ts"))
    rows = rows.withColumn("_last", F.coalesce("_last", carried)).withColumn("was", F.col("_last.status"))
    steps = [F.col("was").eqNullSafe(F.lit(a)) & F.col("status").isin(*b) for a, b in FLOW.items() if a and b]
    legal = F.when(F.col("_last").isNull(), F.col("status").isin(*FLOW[None])).otherwise(~F.coalesce(F.col("was").isin(*filter(None, FLOW)), F.lit(False)))
    for step in steps:
        legal = legal | step
    problem = (
        F.when(~F.coalesce(F.col("status").isin(*filter(None, FLOW)), F.lit(False)), "unknown").when(F.col("ts") < F.col("_last.ts"), "out_of_order")
        .when(F.col("status") == F.col("was"), "repeated").when(~legal, "illegal")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("doc_id", "seq", "was", "status", "problem")


def in_flight(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.bool_or(~F.col("status").isin(*TERMINAL)), F.lit(False)).alias("in_flight"))


def completed_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("processing_status") == "completed").alias("completed"), F.sum("size").alias("total_size"))


def lookup(manifest: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """ids with the manifest's columns and found."""
    return ids.select(key).join(manifest.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recover_missing(manifest: DataFrame, extracted: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed entries without text: (recovered texts, failed events), from raw (id, text)."""
    gaps = manifest.where("processing_status = 'completed'").select("id").join(extracted.select("id"), "id", "left_anti")
    tried = gaps.join(raw.select("id", trim_all(F.col("text")).alias("text")), "id", "left")
    good = F.length(F.coalesce("text", F.lit(""))) >= MIN_TEXT
    return tried.where(good), tried.where(~good).select("id", F.lit("failed").alias("status"), F.lit("text could not be recovered").alias("message"))


def uploads_as_documents(manifest: DataFrame, texts: DataFrame, year_fallback: bool = True) -> DataFrame:
    """Completed uploads as documents (doc_id, title, authors, source, year, content); times are UTC."""
    year = F.year("uploaded_at")
    done = manifest.where("processing_status = 'completed'").join(texts.select("id", F.col("text").alias("content")), "id")
    return done.select(
        F.col("id").alias("doc_id"), F.col("original_filename").alias("title"), F.lit("Uploaded Document").alias("authors"), F.lit("User Upload").alias("source"),
        (F.coalesce(year, F.year(F.current_timestamp())) if year_fallback else year).alias("year"), "content",
    )
