"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset a local session gets a temporary folder of its own;
    on a cluster, whose nodes would not see it, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used, cleared when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    return path


#: Rows of a small table's file, and rows of work that are worth a task.
FILE_ROWS, TASK_ROWS = 200_000, 20_000


#: Bytes of texts to a row group, which is the least that a task reads: with the usual 128 MB a file is one task's.
ROW_GROUP = 8 << 20


def materialise(df: DataFrame, name: str, rows: int | None = None, work: int | None = None, texts: bool = False) -> DataFrame:
    """Write df as Parquet under the shared folder and return the written table.

    This cuts the lineage with files that outlive any executor.  The name gets a random part,
    so that reruns never read each other's tables.

    A small table should not be a file per partition.  rows bounds what it holds: a file for each
    FILE_ROWS; work bounds what it is made from, where making it takes time: a task for each
    TASK_ROWS, and at least two per core.  A table of texts is cut to row groups that tasks can share.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(-(-rows // FILE_ROWS) or 1)
    elif work is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, work // TASK_ROWS))
    out = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    (out.option("parquet.block.size", ROW_GROUP) if texts else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for spark, path in [w for w in _written if any(f.endswith(w[1].split(":", 1)[-1].lstrip("/")) for f in folders)]:
            remove(spark, path)
            _written.remove((spark, path))


def _clear() -> None:
    """What a driver wrote goes when it ends; a stopped session leaves its tables to the folder's owner."""
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone
            return


#: Rows of ids that may be broadcast (some 20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bounded_broadcast(table: DataFrame) -> DataFrame:
    """A materialised table of a few narrow columns, for a join's small side: broadcast if its rows
    are at most BROADCAST_ROWS, else the build side of a shuffled hash join."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")


#: Bytes of an Arrow batch: what a Python task and its executor hold at once of each table.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """For operators that map Arrow batches: lowers the session's maxBytesPerBatch to BATCH_BYTES,
    unless it is lower yet.

    The default of 64 MB fills executors twice, in the JVM's direct memory and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows of the driver.  (By Arrow: a list would start Python workers of another kind.)"""
    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(kind)), kind)


def numbered(rows: DataFrame, by: list, name: str, bound: int | None = None) -> DataFrame:
    """rows with the column name: their 0-based place in the order of by (columns that tell rows apart).

    A range sort, whose parts are counted; the driver gets one number per part.  bound: rows at most."""
    placed = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    placed = materialise(placed, "placed", bound)
    before, starts = 0, {}
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts[part], before = before, before + n
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    offsets = small_table(rows.sparkSession, [{"_part": k, "_start": v} for k, v in starts.items()], "_part int, _start long")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start")
