"""Epsilon grid order join of vectors by cosine.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2 t) apart, in any orthogonal projection
too.  Vectors are projected on principal directions, sorted by their grid cells of width eps on the
leading ones (lexicographic: the epsilon grid order) and cut into sequence intervals.  Pairs of
intervals are joined recursively: a pair of blocks whose bounding boxes are more than eps apart is
skipped, others are halved until they are small and compared, first in single precision on the
leading directions (with slack, so that nothing is lost), then exactly in double precision.

There are about as many pairs of intervals as parallel tasks, so that each vector is sent to a
number of tasks that doesn't grow with the vectors, until intervals reach MOST vectors, what a
task holds; from there on each is sent to all intervals near it.  Vectors travel once per pair, in
the precision they came in.

Equal vectors are joined once.  Within a pair links are counted and nodes are joined to trees in
place, so that a dense group is never held, nor leaves the task, as all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import bounded_broadcast, materialise, numbered, small_batches

COSINE = 0.95
#: Principal directions that form the grid, and those compared first.
GRID_DIMS, LEAD_DIMS = 8, 16
#: Vectors of a sequence interval, least and most; pairs of intervals are the units dealt to tasks.
LEAST, MOST = 512, 1 << 15
#: Blocks of this size are compared; of their pairs so many are looked at one by one, at most.
LEAF, SPARSE = 256, 4096
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with a finite, non-zero vector."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("v"))
            m = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            total = m if total is None else total + m
    if total is not None:
        yield pa.record_batch({"k": pa.array(np.arange(len(total)), pa.int64()), "x": total})


def _axes(reps: DataFrame, dims: int) -> np.ndarray:
    """Principal directions as columns, leading first (d x d numbers reach the driver)."""
    found = reps.select("v").mapInArrow(_moments, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    m = found.sort_values("k")["x"].to_numpy()
    mean, second = m[1 : dims + 1] / m[0], m[dims + 1 :].reshape(dims, dims) / m[0]
    _, axes = np.linalg.eigh(second - np.outer(mean, mean))
    return axes[:, ::-1].copy()


class _Side:
    """Vectors of an interval: numbers, copies, unit vectors and their leading projections."""

    def __init__(self, batches: list[pa.RecordBatch], lead: np.ndarray, first: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.ids, self.copies = rows["seq"].to_numpy(), rows["copies"].to_numpy()
        self.x = np.concatenate([_matrix(c) for c in rows["v"].chunks])
        self.p = (self.x @ lead).astype(np.float32)
        self.sq = (self.p * self.p).sum(1)
        self.links = np.zeros(len(self.ids), np.int64)
        self.node = np.arange(first, first + len(self.ids))
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            part = self.p[lo:hi]
            self.boxes[lo, hi] = part.min(0), part.max(0)
        return self.boxes[lo, hi]


class _Unit:
    """Joins two sequence intervals (or one with itself)."""

    def __init__(self, a: _Side, b: _Side, cosine: float):
        self.a, self.b, self.cosine, self.eps2 = a, b, cosine, 2 - 2 * cosine
        self.parent = np.arange(len(a.ids) + (0 if a is b else len(b.ids)))
        self.join(0, len(a.ids), 0, len(b.ids))

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        (lo_a, hi_a), (lo_b, hi_b) = self.a.box(a0, a1), self.b.box(b0, b1)
        gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
        if float(gap @ gap) > self.eps2 + SLACK:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.leaf(a0, a1, b0, b1)
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            if self.a is self.b and (a0, a1) == (b0, b1):
                self.join(a0, m, a0, m)
                self.join(a0, m, m, a1)
                self.join(m, a1, m, a1)
            else:
                self.join(a0, m, b0, b1)
                self.join(m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            self.join(a0, a1, b0, m)
            self.join(a0, a1, m, b1)

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        a, b = self.a, self.b
        d2 = a.sq[a0:a1, None] + b.sq[b0:b1] - 2 * (a.p[a0:a1] @ b.p[b0:b1].T)
        near = d2 <= self.eps2 + SLACK
        if a is b and a0 == b0:
            near = np.triu(near, 1)
        n = int(near.sum())
        if not n:
            return
        if n <= SPARSE:
            i, j = np.nonzero(near)
            hit = np.einsum("ij,ij->i", a.x[a0 + i], b.x[b0 + j]) >= self.cosine
            i, j = i[hit], j[hit]
        else:
            i, j = np.nonzero(near & (a.x[a0:a1] @ b.x[b0:b1].T >= self.cosine))
        i, j = i + a0, j + b0
        np.add.at(a.links, i, b.copies[j])
        np.add.at(b.links, j, a.copies[i])
        self.merge(a.node[i], b.node[j])

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        at = self.parent[nodes]
        while True:
            up = self.parent[at]
            if (up == at).all():
                self.parent[nodes] = at
                return at
            at = up

    def merge(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join the trees of x and y."""
        while len(x):
            x, y = self.roots(x), self.roots(y)
            apart = x != y
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            # of several lower roots the least is taken now; the others are joined in the next round
            order = np.lexsort((low, high))
            low, high = low[order], high[order]
            first = np.ones(len(high), bool)
            first[1:] = high[1:] != high[:-1]
            self.parent[high[first]] = low[first]
            x, y = high[~first], low[~first]

    def rows(self) -> pa.RecordBatch:
        ids = self.a.ids if self.a is self.b else np.concatenate([self.a.ids, self.b.ids])
        links = self.a.links if self.a is self.b else np.concatenate([self.a.links, self.b.links])
        some, root = np.flatnonzero(links), self.roots(np.arange(len(ids)))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.record_batch(
            [
                pa.concat_arrays([pa.array(ids[some]), none(len(moved))]), pa.concat_arrays([pa.array(links[some]), none(len(moved))]),
                pa.concat_arrays([none(len(some)), pa.array(ids[moved])]), pa.concat_arrays([none(len(some)), pa.array(ids[root[moved]])]),
            ],
            names=["node", "links", "a", "b"],
        )


def cosine_groups(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    n_links: other rows linked directly (cosine >= cosine in double precision); component_id: the
    least id reachable; kept: the row's id is component_id.  A null vector, one of zeros or with a
    null or non-finite component links with nothing.  Vectors link with such of their own length
    only.  Rows that repeat an id count as rows; rows with a null id count as links but have no
    component of their own (null).  Other columns are ignored; an empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    usable = _usable(rows)
    lengths = sorted(r[0] for r in usable.select(F.size("v").alias("d")).distinct().collect())
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # zeros of either sign are equal
    plain = lambda df: df.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x)))
    # equal vectors first: pre-aggregated, so that a very common one is one row
    reps = materialise(plain(usable).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    linked = None
    for dims in lengths:
        part = _linked(reps.where(F.size("v") == dims), dims, cosine)
        linked = part if linked is None else linked.unionByName(part)
    out = plain(rows).join(linked, "v", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept")
    )


def _linked(reps: DataFrame, dims: int, cosine: float) -> DataFrame:
    """v, n_links and component_id of the distinct vectors of one length."""
    sequence, found = _join(reps, dims, cosine)
    found = materialise(found, "links")
    links = found.where("node IS NOT NULL").groupBy(F.col("node").alias("seq")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("a IS NOT NULL").select("a", "b"), rows=found.count()).withColumnRenamed("node", "seq")
    linked = sequence.join(links, "seq", "left").join(components, "seq", "left")
    linked = linked.select("v", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "seq").alias("component"))
    linked = materialise(linked, "linked")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    return linked.join(least, "component").select("v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")


def _join(reps: DataFrame, dims: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The sequence (seq, v, id, copies), and rows (node, links) and (a, b) over its numbers."""
    spark = reps.sparkSession
    axes = _axes(reps, dims)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    lead, grid = axes[:, : min(LEAD_DIMS, dims)].copy(), min(GRID_DIMS, dims)
    v_type = reps.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column("v")) @ lead[:, :grid]
                cell = np.floor(p / max(eps, 1e-6) + 1e6).astype(">u4")
                yield batch.append_column("cell", pa.array([c.tobytes() for c in cell], pa.binary()))

    placed = reps.mapInArrow(place, f"v {v_type}, id {reps.schema['id'].dataType.simpleString()}, copies long, cell binary")
    # vectors of one cell in any order that tells them apart
    order = [F.col("cell"), F.xxhash64("v"), F.col("v")]
    sequence = materialise(numbered(placed, order, "seq").drop("cell"), "sequence")
    total = sequence.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(MOST, max(LEAST, -(-total // max(2, math.isqrt(2 * tasks)))))
    sequence_at = sequence.withColumn("interval", F.floor(F.col("seq") / size).cast("int"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, at = _matrix(batch.column("v")) @ lead, batch.column("interval").to_numpy()
                for k in np.unique(at).tolist():
                    q = p[at == k]
                    yield pa.record_batch({"interval": pa.array([k], pa.int32()), "lo": [q.min(0).tolist()], "hi": [q.max(0).tolist()]})

    part = sequence_at.select("interval", "v").mapInArrow(boxes, "interval int, lo array<double>, hi array<double>")
    merged = lambda f, c: F.array(*(f(F.col(c)[k]) for k in range(lead.shape[1]))).alias(c)
    box = materialise(part.groupBy("interval").agg(merged(F.min, "lo"), merged(F.max, "hi")), "boxes")
    # intervals that come within eps on the first direction meet in one of its cells; the cell of
    # the later start decides, so that each pair is found once
    cell = lambda c: F.floor(c / F.lit(max(eps, 1e-6))).cast("long")
    box = box.withColumn("c0", cell(F.col("lo")[0])).withColumn("c", F.explode(F.sequence("c0", cell(F.col("hi")[0] + F.lit(eps + 1e-3)))))
    left, right = (box.select("c", *(F.col(k).alias(f"{k}_{s}") for k in ("interval", "lo", "hi", "c0"))) for s in "ab")
    gap = F.zip_with(
        F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= F.lit(eps * eps + SLACK)
    pairs = left.join(right, "c").where("interval_a <= interval_b AND c = greatest(c0_a, c0_b)").where(near).select("interval_a", "interval_b")
    units = materialise(numbered(pairs, [F.col("interval_a"), F.col("interval_b")], "unit"), "units")
    # an interval's vectors go to each of its units; side 1 is the second of two
    a, b = (units.select(F.col(f"interval_{s}").alias("interval"), "unit", F.lit(k).alias("side")) for k, s in enumerate("ab"))
    # of a unit of one interval with itself only side 0 is sent
    routes = a.unionByName(b).groupBy("interval", "unit").agg(F.min("side").alias("side"))
    sent = sequence_at.select("interval", "seq", "copies", "v").join(bounded_broadcast(materialise(routes, "routes")), "interval")
    dealt = sent.select("unit", "side", "seq", "copies", "v").repartitionById(min(max(1, units.count()), tasks), (F.col("unit") % tasks).cast("int"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit and side."""
        unit, sides = None, ([], [])

        def out() -> pa.RecordBatch:
            a = _Side(sides[0], lead, 0)
            return _Unit(a, _Side(sides[1], lead, len(a.ids)) if sides[1] else a, cosine).rows()

        for batch in batches:
            of, side = batch.column("unit").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(of)]
            for x, y in zip(edges[:-1], edges[1:]):
                if y > x:
                    if unit is not None and of[x] != unit:
                        yield out()
                        sides = ([], [])
                    unit = of[x]
                    sides[side[x]].append(batch.slice(x, y - x).select(["seq", "copies", "v"]))
        if unit is not None:
            yield out()

    found = dealt.sortWithinPartitions("unit", "side", "seq").mapInArrow(join, "node long, links long, a long, b long")
    return sequence, found
