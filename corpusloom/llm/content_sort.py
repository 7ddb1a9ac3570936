"""Exact duplicates by content sort, with DataFrame functions only.

Rows are range-partitioned by sampled splitters and sorted within partitions by their normalised
text (externally, with spill), so that equal texts are neighbours; the window operator compares
neighbours in full.  Splitters are the text's first characters with a hash behind them, so that
they stay short however long texts are, and texts with one beginning still spread.

A text with very many copies would fill one range.  A thin first pass counts hashes; those with
more copies than a fraction of a partition get a salt in the key, and their parts, one row per
salt, are compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the text that lead the sort key.
KEY_CHARS = 16
#: A text with more copies than rows / (partitions * SHARE) gets salts.
SHARE = 4


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else as it is."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes A-Z alone where all characters are single bytes
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _salts(hashed: DataFrame, parts: int) -> DataFrame:
    """h, salts of the texts with many copies: at most parts * SHARE rows (hashed is read twice)."""
    total = hashed.count()
    most = max(2, total // (parts * SHARE))
    counted = materialise(hashed.groupBy("h").agg(F.count("*").alias("copies")).where(F.col("copies") > most), "copies", work=total)
    # equal texts are equal under lower() too, so that its hash is good for finding heavy groups
    return counted.select("h", (F.col("copies") / most).cast("int").alias("salts"))


def _hash() -> Column:
    return F.xxhash64(F.lower(F.coalesce("text", F.lit(""))))


def _placed(rows: DataFrame, heavy: DataFrame, parts: int) -> DataFrame:
    """rows (doc_id, text, h, ...) with text normalised, in ranges of the sort key; salts is null for most."""
    keyed = rows.join(F.broadcast(heavy), "h", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("salts"))).cast("int")
    )
    keyed = keyed.withColumn("lead", F.substring(F.lower(F.coalesce("text", F.lit(""))), 1, KEY_CHARS))
    return keyed.repartitionByRange(parts, *_KEY).withColumn("text", normalised(F.col("text")))


#: What splitters are made of; the text decides it, but for the salt.
_KEY = ("lead", "h", "salt")


def _first(keep: str) -> Column:
    return F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()


def exact_groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    keep: "min" or "max", which doc_id of equal texts stays.  Null and empty texts are equal to
    each other.  A null doc_id stays only if its whole group has none (keep_id is then null, and
    kept holds for those rows).  Rows that repeat the doc_id that stays are kept on one of the
    rows.  Very long texts are compared whole; other columns, whatever their names, are ignored;
    an empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", _hash().alias("h"))
    placed = _placed(rows, _salts(rows.select("h"), parts), parts)
    best = F.min if keep == "min" else F.max
    same = W.partitionBy("text", *_KEY).orderBy(_first(keep))
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = placed.select(
        "doc_id",
        "h",
        "salts",
        F.sha2("text", 256).alias("text_sha256"),
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count("*").over(whole).alias("group_size"),
        F.row_number().over(same).alias("place"),
        "text",
    ).withColumn("text", F.when(F.col("salts").isNotNull() & (F.col("place") == 1), F.col("text")))
    seen = materialise(seen, "sorted")
    # the parts of salted groups, compared in full once more: a row per salt and text
    merged = (
        seen.where("text IS NOT NULL")
        .groupBy("h", "text", "text_sha256")
        .agg(best("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
        .select(F.col("h").alias("mh"), F.col("text_sha256").alias("ms"), "all_keep", "all_size")
    )
    out = seen.drop("text").join(
        F.broadcast(merged), F.col("salts").isNotNull() & (F.col("h") == F.col("mh")) & (F.col("text_sha256") == F.col("ms")), "left"
    )
    keep_id = F.when(F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs, with all columns: of equal texts one row stays, that of the least (or largest) doc_id.

    Rows, not ids, stay or go: of rows that repeat a doc_id each text keeps one, and a row with a
    null doc_id goes only if an equal text stays.  Of rows equal in doc_id and text any one stays.
    Null and empty texts are equal to each other; other columns may have any names; an empty table
    gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = _salts(docs.select(_hash().alias("h")), parts)
    # columns of docs travel in one, where no name clashes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    placed = _placed(rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).withColumn("h", _hash()), heavy, parts)
    place = F.row_number().over(W.partitionBy("text", *_KEY).orderBy(_first(keep)))
    first = materialise(placed.withColumn("place", place).where("place = 1").select("row", "h", "salts"), "first")
    # of a salted text each salt has kept one: the last comparison, of few rows
    again = first.where("salts IS NOT NULL").withColumn("text", normalised(F.col("row.text"))).withColumn("doc_id", F.col("row.doc_id"))
    again = again.withColumn("place", F.row_number().over(W.partitionBy("h", "text").orderBy(_first(keep)))).where("place = 1")
    return first.where("salts IS NULL").select("row.*").unionByName(again.select("row.*"))
