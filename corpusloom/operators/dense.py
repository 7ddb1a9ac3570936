"""Dense search through an index: vectors by cells around centroids, so that a question meets near cells only.

A folder holds vectors (vec_id, v, cell, slice), written by cell and slice, and cells (cell, centroid,
radius, slices, probes: how many cells a question looks into, fitted on the sample too).  Centroids are fitted on a sample of some SAMPLE vectors, chosen by a hash of vec_id; every
vector is assigned.  A cell is cut into slices of some SLICE vectors, and its questions into blocks of
some BLOCK, so that a task holds one of each, however many vectors or questions a cell has.

Vectors that are null, of zeros only, or hold null or non-finite numbers are in no result, as question or
as answer.  Rows with a vec_id of its own each are expected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.search import K, top_k
from corpusloom.sources.shared import materialise, small_batches, small_table

#: Vectors that centroids are fitted on (what the driver holds), and cells at most.
SAMPLE, CELLS = 16_384, 1_024
#: Vectors of a cell and questions of a cell that a task holds at once, on average.
SLICE, BLOCK = 8_192, 2_048
#: An approximate search looks into as many cells as held this share of the nearest FIT_K within the
#: sample, of FIT_ASKED of its rows.  (In the whole table the nearest are nearer, and the share is larger.)
TARGET, FIT_K, FIT_ASKED = 0.95, 10, 1_024
#: Scores have 4 places: what lies this far below the last of the k best can't reach it.
MARGIN = 1e-4
_BUCKETS = 1 << 30


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose v has a direction."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column) -> np.ndarray:
    """Rows of unit length."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in chunks if len(c)]
    x = np.concatenate(parts) if parts else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fit(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length of the directions x, from evenly spaced rows of it."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _probes_for(x: np.ndarray, centres: np.ndarray) -> int:
    """How many of its nearest cells a row of x looks into to meet TARGET of its FIT_K nearest rows."""
    asked = np.unique(np.linspace(0, len(x) - 1, min(FIT_ASKED, len(x))).astype(int))
    k = min(FIT_K, len(x) - 1)
    if k < 1:
        return 1
    cos = x[asked] @ x.T
    cos[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    cell = (x @ centres.T).argmax(1)
    return 1 + int(np.quantile(np.take_along_axis(rank, cell[near], 1), TARGET, method="higher"))


def build(vectors: DataFrame, path: str, cells: int | None = None) -> Index:
    """Index vectors (vec_id long, v) under path.  cells: as many as the root of the vectors' number, CELLS at most."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors.select(F.col("vec_id").cast("long"), "v"))
    n = rows.count()
    share = min(_BUCKETS, math.ceil(_BUCKETS * SAMPLE / max(n, 1)))
    place = F.xxhash64("vec_id")
    sample = rows.where(F.pmod(place, F.lit(_BUCKETS)) < share).withColumn("h", place).limit(2 * SAMPLE).toArrow().sort_by([("h", "ascending"), ("vec_id", "ascending")])
    x = _matrix(sample["v"])
    cells = min(cells or CELLS, CELLS, max(1, math.ceil(math.sqrt(n))), max(1, len(x)))
    centres = _fit(x, cells) if len(x) else np.zeros((1, 1))
    held = np.bincount((x @ centres.T).argmax(1), minlength=cells) if len(x) else np.zeros(1, int)
    slices = np.maximum(1, np.ceil(held / max(1, len(x)) * n / SLICE)).astype(np.int32)
    shared = spark.sparkContext.broadcast((centres, slices))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, slices = shared.value
        for b in batches:
            if b.num_rows:
                cos = _matrix(b.column("v")) @ centres.T
                cell = cos.argmax(1).astype(np.int32)
                angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
                part = (b.column("h").to_numpy() % slices[cell]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell), pa.array(part), pa.array(angle)], ["vec_id", "v", "cell", "slice", "angle"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.withColumn("h", place).mapInArrow(assign, f"vec_id long, v {kind}, cell int, slice int, angle double")
    placed.repartition("cell", "slice").sortWithinPartitions("cell", "slice").write.mode("overwrite").parquet(f"{path}/vectors")
    radius = {r["cell"]: r["radius"] for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius")).collect()}
    probes = _probes_for(x, centres)
    table = [{"cell": c, "centroid": centres[c].tolist(), "radius": radius[c], "slices": int(slices[c]), "probes": probes} for c in sorted(radius)]
    small_table(spark, table, "cell int, centroid array<double>, radius double, slices int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Index(spark, path)


class Index:
    """An index that build has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.vectors = spark.read.parquet(f"{path}/vectors")
        table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # CELLS rows at most
        self.cells = table["cell"].to_numpy()
        self.slices = table["slices"].to_numpy()
        self.probes = int(table["probes"][0].as_py()) if len(table) else 1
        self._shared = spark.sparkContext.broadcast((_matrix(table["centroid"]), table["radius"].to_numpy(), self.cells))

    def search(self, queries: DataFrame, k: int = K, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, score (cosine, 4 places), rank: the k best of another id for queries (query_id long, v).

        Each question looks into its nearest cells, as many as probes or what was fitted.  exact: and into each other cell
        that can hold a vector as near as the last of those found, by the angles to its centroid and within it;
        results are those of all pairs then.  Of equal scores the smaller vec_id comes first."""
        small_batches(self.spark)
        asked = materialise(usable(queries.select(F.col("query_id").cast("long"), "v")), "asked")
        first = probes or self.probes
        found = materialise(top_k(self._against(self._probes(asked, first), k), k, "vec_id"), "found")
        if not exact or first >= len(self.cells):
            return found
        last = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        more = self._against(self._probes(asked.join(last, "query_id", "left"), first, rest=True), k)
        return top_k(found.drop("rank").unionByName(more), k, "vec_id")

    def _probes(self, asked: DataFrame, first: int, rest: bool = False) -> DataFrame:
        """query_id, v, cell: each question's first cells, or of the rest those that its least score allows."""
        shared = self._shared

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, cells = shared.value
            for b in batches:
                if b.num_rows and len(cells):
                    cos = _matrix(b.column("v")) @ centres.T
                    near = np.zeros(cos.shape, bool)
                    np.put_along_axis(near, np.argsort(-cos, axis=1, kind="stable")[:, :first], True, 1)
                    if rest:
                        least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                        angle = np.arccos(np.clip(cos, -1, 1))
                        most = np.cos(np.maximum(0, angle - radius))
                        near = ~near & ~(most < least[:, None] - MARGIN)  # no least score (NaN): all
                    at, cell = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(at)), pa.array(at.astype(np.int32)), pa.array(cells[cell])], ["query_id", "at", "cell"])

        # vectors join afterwards: a batch of questions times cells would hold each as often as it has cells
        pairs = asked.mapInArrow(task, "query_id long, at int, cell int").drop("at")
        return pairs.join(asked.select("query_id", "v"), "query_id")

    def _against(self, probes: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score: the k best of each slice that a question looks into."""
        spark = self.spark
        wanted = materialise(probes, "probes")
        asked = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = [{"cell": int(c), "slices": int(s), "blocks": -(-asked[int(c)] // BLOCK)} for c, s in zip(self.cells, self.slices) if int(c) in asked]
        sizes = F.broadcast(small_table(spark, sizes, "cell int, slices int, blocks int"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = wanted.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("slice", upto("slices")).select("cell", "slice", "block", "query_id", "v")
        right = self.vectors.where(F.col("cell").isin(*asked) if asked else F.lit(False)).join(sizes, "cell").withColumn("block", upto("blocks")).select("cell", "slice", "block", "vec_id", "v")

        def best(q: pa.Table, x: pa.Table) -> pa.Table:
            none = np.zeros(0, np.int64)
            if not q.num_rows or not x.num_rows:
                return pa.table({"query_id": none, "vec_id": none, "score": none.astype(float)})
            ids, names, m = q["query_id"].to_numpy(), x["vec_id"].to_numpy(), _matrix(q["v"])
            every = _matrix(x["v"])
            score, which = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for at in range(0, len(names), 1024):
                some = names[at : at + 1024]
                new = np.round(m @ every[at : at + 1024].T, 4)
                new[ids[:, None] == some] = -np.inf
                score, which = np.concatenate([score, new], 1), np.concatenate([which, np.broadcast_to(some, new.shape)], 1)
                order = np.lexsort((which, -score), axis=1)[:, :k]
                score, which = np.take_along_axis(score, order, 1), np.take_along_axis(which, order, 1)
            hit = score > -np.inf
            return pa.table({"query_id": ids[np.nonzero(hit)[0]], "vec_id": which[hit], "score": score[hit]})

        keys = ["cell", "slice", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def recall(found: DataFrame, best: DataFrame) -> DataFrame:
    """asked, recall: of the best (query_id, vec_id) of all pairs the share that was found, over all questions."""
    both = best.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("asked"), (F.count("hit") / F.count("*")).alias("recall"))
