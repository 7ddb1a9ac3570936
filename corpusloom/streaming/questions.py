"""A cache of earlier questions: a stream of new ones is matched against those before.

State is a folder of three tables, each with a folder per micro-batch (b): vectors (query_id, term, weight), heads
(query_id, term: those that can propose a pair, see operators.search), in places by term, and matches
(query_id, earlier, score).  A micro-batch reads those before it only, and one that is tried again
replaces its own files, so that each counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.search import heads_of, scored_pairs
from corpusloom.sources.shared import materialise

#: Places of heads; a micro-batch reads those of its terms.
PLACES = 64
VECTORS, HEADS, MATCHES = "query_id long, term string, weight double, b long", "query_id long, term string, b long, place int", "query_id long, earlier long, score double, b long"


def start_matching(questions: DataFrame, cache: str, checkpoint: str, weigh: Callable[[DataFrame], DataFrame], df: DataFrame, least: float):
    """Follows questions (query_id long, question; availableNow) and finds for each the earlier ones with cosine
    of least or more: those of micro-batches before it, and in its own those with smaller ids.

    weigh gives (query_id, term, weight) of unit length for (query_id, question), df (term, df); both
    must stay the same as long as the cache is used, since stored heads follow them.  Questions without terms
    are cached nowhere and match nothing.  A query_id should come once; rows that repeat in a micro-batch count once."""
    spark = questions.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        fresh = batch.select("query_id", "question").dropDuplicates(["query_id"])
        vectors = _write(weigh(fresh).select("query_id", "term", "weight"), cache, "vectors", number)
        heads = materialise(heads_of(vectors, df, least).withColumn("place", F.pmod(F.xxhash64("term"), F.lit(PLACES)).cast("int")), "heads")
        places = sorted(r["place"] for r in heads.select("place").distinct().collect())  # PLACES at most
        before = _before(spark, cache, "heads", HEADS, number)
        if before is None:
            old_heads, old = heads.select("query_id", "term"), vectors
        else:
            old_heads = before.where(F.col("place").isin(*places) if places else F.lit(False)).select("query_id", "term").unionByName(heads.select("query_id", "term"))
            old = _before(spark, cache, "vectors", VECTORS, number).select("query_id", "term", "weight").unionByName(vectors)
        own = vectors.select(F.col("query_id").alias("earlier")).distinct().withColumn("own", F.lit(True))
        pairs = heads.select("query_id", "term").join(old_heads.withColumnRenamed("query_id", "earlier"), "term").select("query_id", "earlier").distinct()
        pairs = materialise(pairs.join(own, "earlier", "left").where("own IS NULL OR earlier < query_id").select(F.col("query_id").alias("a"), F.col("earlier").alias("b")), "pairs")
        # vectors of the earlier ones that were proposed, not of all
        near = old.join(pairs.select(F.col("b").alias("query_id")).distinct(), "query_id", "left_semi")
        found = scored_pairs(pairs, vectors, near, least)
        _write(found.select(F.col("a").alias("query_id"), F.col("b").alias("earlier"), "score"), cache, "matches", number)
        heads.repartition("place").write.mode("overwrite").partitionBy("place").parquet(f"{cache}/heads/b={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write(rows: DataFrame, cache: str, table: str, number: int) -> DataFrame:
    path = f"{cache}/{table}/b={number}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _before(spark: SparkSession, cache: str, table: str, schema: str, number: int) -> DataFrame | None:
    """What the micro-batches before a number wrote."""
    return spark.read.schema(schema).parquet(f"{cache}/{table}").where(F.col("b") < number) if number else None


def matches(spark: SparkSession, cache: str) -> DataFrame:
    """query_id, earlier, score of all micro-batches."""
    return spark.read.schema(MATCHES).parquet(f"{cache}/matches").select("query_id", "earlier", "score")
