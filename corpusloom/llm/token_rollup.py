"""Token counts kept as delta-maintained rollups.

State is a folder with a ledger (what the documents are counted as), totals (sums per source,
language and tokenizer version) and commits.  A batch's changes become signed deltas against the
ledger, which are added to the totals; both are written to folders of this attempt alone, and the
commit, which names the folders that are in force, comes last.  Readers see what the last commit
names.  So a batch that fails at any point leaves nothing to be seen and may be tried again, and
one that is committed is left alone: each counts once.

The ledger grows by a folder per batch; at every COMPACT-th the latest entries of all become one
folder, so that a batch reads few files however many came before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, small_table
from .tokens import encoder

KEYS = ("source", "lang", "version")
_LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, batch long"
_TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
_COMMITS = "batch long, ledger array<string>, totals string"
#: Ledger folders that are merged into one.
COMPACT = 8


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, lang, n_tokens of each row, ids as by tokenizers.

    Null and empty texts have 0; each row counts, repeated ones too; very long texts are read
    whole; other columns are ignored; an empty table gives no rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            n = [np.zeros(0, np.int64), *(np.diff(at) for *_, at in encode.ids(batch.column("text")))]
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "source", "lang")), pa.array(np.concatenate(n))], names=["doc_id", "source", "lang", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return rows.mapInArrow(task, "doc_id long, source string, lang string, n_tokens long")


class Rollup:
    """Totals under a folder that all executors share.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[Row]:
        """What was committed, in order (a few bytes per batch)."""
        try:
            return sorted(self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").collect(), key=lambda r: r["batch"])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else small_table(self.spark, [], schema)

    def _write(self, rows: DataFrame, folder: str) -> str:
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return folder

    def committed(self) -> list[int]:
        return [r["batch"] for r in self._commits()]

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch of changes (doc_id, version, op, source, lang, n_tokens); False if it was
        committed before.

        op is insert or revise (the document's count and place become these, whether it was known
        or not) or delete (unknown documents are passed over).  Batches apply in order of their
        numbers.  Of several rows for one document and version the delete counts, else the largest
        count.  Null source and lang are groups of their own; a null count is 0; rows with a null
        doc_id or version are left out; other columns are ignored; an empty table is a batch that
        changes nothing.
        """
        commits = self._commits()
        if any(r["batch"] == batch for r in commits):
            return False
        if commits and batch < commits[-1]["batch"]:
            raise ValueError(f"batch {batch} comes after {commits[-1]['batch']} was committed")
        ledgers, totals = (list(commits[-1]["ledger"]), [commits[-1]["totals"]]) if commits else ([], [])
        attempt = f"{batch}-{uuid.uuid4().hex}"
        last = F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")
        new = changes.where("doc_id IS NOT NULL AND version IS NOT NULL").groupBy("doc_id", "version").agg(F.max(last).alias("new"))
        both = new.join(self._current(ledgers), ["doc_id", "version"], "left")
        kept = F.when(~F.col("new.gone"), F.col("new.n_tokens"))
        entry = both.where("NOT new.gone OR old.n_tokens IS NOT NULL").select(
            "doc_id", "version", F.col("new.source").alias("source"), F.col("new.lang").alias("lang"), kept.alias("n_tokens"),
            F.lit(batch).cast("long").alias("batch"), F.col("old"),
        )
        # the entries with what they replace: deltas come from what is written, not from changes read again
        ledgers.append(self._write(entry, f"ledger/{attempt}"))
        entry = self._read(ledgers[-1:], f"{_LEDGER}, old struct<source:string,lang:string,n_tokens:long>")
        gone = entry.where("old.n_tokens IS NOT NULL").select("old.source", "old.lang", "version", F.lit(-1).alias("n_docs"), (-F.col("old.n_tokens")).alias("n_tokens"))
        come = entry.where("n_tokens IS NOT NULL").select("source", "lang", "version", F.lit(1).alias("n_docs"), "n_tokens")
        deltas = gone.unionByName(come).unionByName(self._read(totals, _TOTALS))
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        in_force = self._write(summed.where("n_docs <> 0 OR n_tokens <> 0"), f"totals/{attempt}")
        if len(ledgers) >= COMPACT:
            state = self._current(ledgers).where("old.n_tokens IS NOT NULL").select("doc_id", "version", "old.*", F.lit(batch).cast("long").alias("batch"))
            ledgers = [self._write(state, f"ledger/{attempt}-all")]
        commit = small_table(self.spark, [{"batch": batch, "ledger": ledgers, "totals": in_force}], _COMMITS)
        self._write(commit.coalesce(1), f"commits/b={batch}")
        return True

    def _current(self, ledgers: list[str]) -> DataFrame:
        """doc_id, version, old: the latest entry of each; n_tokens is null for a deleted one."""
        return self._read(ledgers, _LEDGER).groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("old"))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what is there now (groups of no documents go)."""
        commits = self._commits()
        return self._read([commits[-1]["totals"]] if commits else [], _TOTALS)
