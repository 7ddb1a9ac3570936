"""Records of mixed shape: read as VARIANT, and those that can't be used written aside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CORRUPT = "_corrupt_record"


def read_run_variants(spark: SparkSession, path: str, per_line: bool = True) -> DataFrame:
    """run (variant), _corrupt_record (what doesn't parse), run_id: of JSON lines with their run_id in
    them; or, not per_line, of one JSON document per file, named after its run.  Empty lines are no records."""
    read = spark.read.schema(f"run variant, {_CORRUPT} string").option("singleVariantColumn", "run").option("multiLine", not per_line).option("recursiveFileLookup", True)
    runs = read.json(path)
    if per_line:
        return runs.withColumn("run_id", F.try_variant_get("run", "$.run_id", "string"))
    return runs.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def run_problem(run: Column, run_id: Column, corrupt: Column) -> Column:
    """Why a record is no recorded run, or null: not_json, not_an_object, no_id, no_steps."""
    shape = F.schema_of_variant(run)
    steps = F.try_variant_get(run, "$.steps", "array<variant>")
    return F.when(corrupt.isNotNull() | run.isNull(), "not_json").when(~shape.startswith("OBJECT"), "not_an_object").when(F.coalesce(run_id, F.lit("")) == "", "no_id").when(steps.isNull(), "no_steps")


def event_problem() -> Column:
    """Why a row of read_manifest is no event, or null: not_json, not_an_object, wrong_kind (a field's), no_id."""
    parsed = F.try_parse_json(_CORRUPT)
    corrupt = F.when(parsed.isNull(), "not_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object").otherwise("wrong_kind")
    return F.when(F.col(_CORRUPT).isNotNull(), corrupt).when(F.col("doc_id").isNull() | F.col("seq").isNull() | F.col("status").isNull(), "no_id")


def set_aside(rows: DataFrame, problem: Column, path: str, batch: int) -> DataFrame:
    """Write rows under path in one pass, those with a problem apart, and return the others of this batch.

    A folder per batch: one that is tried again replaces its rows.  Nothing is dropped: see aside."""
    rows.withColumn("problem", problem).withColumn("good", F.col("problem").isNull()).write.mode("overwrite").partitionBy("good").parquet(f"{path}/batch={batch}")
    kept = rows.sparkSession.read.schema(rows.schema.add("good", "boolean")).parquet(f"{path}/batch={batch}")
    return kept.where("good").drop("good", _CORRUPT)


def aside(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were set aside, with problem and batch; empty where there are none.
    schema: that of the rows."""
    try:
        return spark.read.schema(f"{schema}, problem string, good boolean, batch int").parquet(path).where("NOT good").drop("good")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, problem string, batch int")
