"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is: rare shingles first (by hash), frequent ones last (by estimated
document frequency).  It is cut into vertical fragments: equal ranges of the rare ones, and the
frequent ones.  The overlaps of a pair's fragments are counted separately and summed per pair, so
that each link rests on an exact count.  Pairs whose sum can't reach the threshold are pruned
before: those whose first shingles of the order, the prefixes, have nothing in common, and those
that sizes or sketches rule out.

1. One scan counts shingles that repeat within a task; their summed counts estimate document
   frequencies, which only shape the order (any order gives the same links).
2. One scan writes per document: set size, 64-bit class (equal sets, equal class; a second hash
   tells classes apart that clash), prefix and a parity sketch.  Two sets with Jaccard >= t share
   a prefix shingle.
3. Prefix shingles are dealt out by hash.  The place of a shingle in a set bounds the size of a
   partner whose first common shingle it is; members without a partner in bounds go.  In each
   group of a shingle all members are proposed with one hub: as many pairs as members.  Those
   that sketches allow (see 4) are counted exactly; links are joined to components.
4. Groups that still hold several components are compared in blocks, less pairs that the bounds
   or the sketches rule out: the parity sketches of x and y differ in at most |x - y| + |y - x|
   bits.  A first round counts a forest of the most alike pairs, fewer than members; a second
   one all that are still allowed between different components.

Left out are only pairs whose ends are already known to be in one component, so components are
exact, and links are enough for the components.  For the whole join (`ngram_links` with every) one
round of 4 compares all members of all groups, whatever their components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import bounded_broadcast, discard, materialise, small_batches
from .words import count_repeats, mix, shingle_sets

N_WORDS = 5
#: Jaccard threshold in hundredths.
PERCENT = 75
#: Vertical fragments of the global order, in which partial overlaps are counted.
FRAGMENTS = 4
#: A shingle counts towards the frequency estimate in a task that holds it this often.
LOCAL_COUNT = 4
#: Shingles estimated to be in this many texts come last in the order; at most ORDERED of them
#: (8 bytes each in every task), the most frequent; others stand among the rare ones.
FREQUENT, ORDERED = 32, 1 << 19
#: A frequent shingle's group is split into parts of about so many members before hubs are chosen.
HUB_GROUP = 20_000
#: Members of a group that are compared with each other at once.
BLOCK = 1024
#: Ids of texts to read again that may be broadcast (16 bytes each, or so); more are joined by a shuffle.
BROADCAST_IDS = 200_000

_S = lambda a: a.view(np.int64)


def _frequent(docs: DataFrame, n_words: int) -> np.ndarray:
    """Frequent shingles, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_repeats((s for batch in batches for s in shingle_sets(batch.column("text"), n_words)), LOCAL_COUNT)

    counted = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counted.where((F.col("c") >= FREQUENT) & F.col("h").isNotNull()).orderBy(F.desc("c"), "h").limit(ORDERED).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].view(np.uint64).copy(), top["c"].to_numpy(np.int64)[::-1].copy()


def _class_keys(s: np.ndarray) -> tuple[int, int]:
    """Twice 64 bits that stand for a whole set."""
    n = len(s)
    if not n:
        return 0, 0
    both = mix(np.bitwise_xor.reduce(mix(s + np.uint64(n)), keepdims=True) + s.sum(keepdims=True))
    again = mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True)
    return int(_S(mix(both + np.uint64(n)))[0]), int(_S(mix(again + np.uint64(n)))[0])


def _sketch_bits(n: int) -> int:
    return 1 << max(6, int(4 * n - 1).bit_length())


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of about 4 n buckets."""
    bits = _sketch_bits(len(s))
    odd = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signatures(docs: DataFrame, n_words: int, percent: int, hot: np.ndarray, hot_count: np.ndarray) -> tuple[DataFrame, dict[int, int]]:
    """Per row (doc_id, th): n, cls, check, sketch, prefix; and the parts of very frequent shingles."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order.astype(np.int64)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            cols = {"n": [], "cls": [], "check": [], "sketch": []}
            prefixes, ends = [], [0]
            for s in shingle_sets(batch.column("text"), n_words):
                n = len(s)
                for k, x in zip(cols, (n, *_class_keys(s), _sketch(s) if n else b"")):
                    cols[k].append(x)
                p = n - -(-percent * n // 100) + 1 if n else 0
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    r = np.where(known[at] == s, rank[at] + 1, 0)
                    s = s[np.argsort(r, kind="stable")]
                prefixes.append(_S(s[:p].copy()))
                ends.append(ends[-1] + p)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            longs = [pa.array(cols[k], pa.int64()) for k in ("n", "cls", "check")]
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("th"), *longs, pa.array(cols["sketch"], pa.binary()), prefix],
                names=["doc_id", "th", "n", "cls", "check", "sketch", "prefix"],
            )

    rows = "doc_id long, th long, n long, cls long, check long, sketch binary, prefix array<long>"
    table = materialise(docs.mapInArrow(sign, rows), "signatures")
    # groups of these are split before hubs are chosen
    many = hot_count > HUB_GROUP
    return table, dict(zip(hot[many].view(np.int64).tolist(), (hot_count[many] // HUB_GROUP + 1).tolist()))


def _classes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table, and a row per class: cls, n, sketch, and doc_id and th of its first row.

    Sets whose class keys clash, which 64 bits let happen among some 10 ** 10, get new keys."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row")
    group = lambda t: t.groupBy("cls").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    reps = materialise(group(table), "classes")
    if (clash := reps.where("lo < hi").select("cls")).limit(1).count():
        marked = table.join(F.broadcast(clash.withColumn("clash", F.lit(True))), "cls", "left")
        table = materialise(marked.withColumn("cls", F.when(F.col("clash"), F.xxhash64("cls", "check")).otherwise(F.col("cls"))).drop("clash"), "signatures")
        reps = materialise(group(table), "classes")
    return table, reps.select("cls", "n", "sketch", "row.doc_id", "row.th")


def _hubs(entries: DataFrame, parts: dict[int, int], percent: int) -> DataFrame:
    """Per shingle: its members (h, cls, n, top) with a hub of their part.

    A set of n shingles whose first common shingle with another stands at place i of the order
    shares n - i at most, so that the other has top = (100 + percent) (n - i) / percent - n at
    most.  Members of whole groups (part 0) that no other member's size suits go.
    """
    spread = dict(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets need one entry; forgetting some costs time only
        keys = np.array(sorted(spread), np.int64)
        split = np.array([spread[k] for k in keys.tolist()], np.int64)
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            fresh = []
            for i, x in enumerate(cls.tolist()):
                if x not in seen:
                    fresh.append(i)
                    seen.add(x)
            if len(seen) > 1_000_000:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            lists = batch.column("prefix")
            at = lists.value_parent_indices().to_numpy()
            h = lists.flatten().to_numpy()
            c, n = batch.column("cls").to_numpy()[at], batch.column("n").to_numpy()[at]
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) if len(h) else at
            place = np.arange(len(h)) - np.concatenate([[0], ends])[at]
            top = (100 + percent) * (n - place) // percent - n
            part = np.zeros(len(h), np.int64)
            if len(keys) and len(h):
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                part = np.where(keys[k] == h, np.abs(c) % split[k] + 1, 0)
            for i in range(0, len(h), 100_000):
                j = slice(i, i + 100_000)
                yield pa.record_batch({"h": h[j], "part": part[j], "cls": c[j], "n": n[j], "top": top[j]})

    names = ("h", "part", "cls", "n", "top")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (h, part, cls); the first of a group that stays is its hub."""
        held = [np.zeros(0, np.int64)] * 5
        last = None  # of a group whose first rows are out: the latest row, hub, hub_n, hub_top
        for batch in chain(batches, [None]):
            rows = held if batch is None else [np.concatenate([x, batch.column(k).to_numpy()]) for x, k in zip(held, names)]
            size = len(rows[0])
            if not size:
                continue
            starts = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]))
            cut = size if batch is None or size - starts[-1] > HUB_GROUP else int(starts[-1])
            open_end = batch is not None and cut == size  # a long group goes out in stretches
            held = [x[cut:] for x in rows]
            if not cut:
                continue
            h, part, c, n, top = (x[:cut] for x in rows)
            copy = np.zeros(cut, bool)
            copy[1:] = (h[1:] == h[:-1]) & (part[1:] == part[:-1]) & (c[1:] == c[:-1])
            goes_on = last is not None and (h[0], part[0]) == last[:2]
            copy[0] = goes_on and c[0] == last[2]
            latest = (h[-1], part[-1], c[-1])
            h, part, c, n, top = (x[~copy] for x in (h, part, c, n, top))
            if not len(h):
                continue
            group = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (part[1:] != part[:-1]))])
            free = part != 0
            if goes_on:
                free |= group == 0
            if open_end:
                free |= group == group[-1]
            # other members with sizes from percent % of n to top
            big = int(max(n.max(), top.max())) + 2
            key = np.sort(group * big + n)
            low = group * big - (-percent * n // 100)
            others = np.searchsorted(key, group * big + np.maximum(top, 0), "right") - np.searchsorted(key, low, "left") - (n <= top)
            stays = free | (others > 0)
            h, part, c, n, top, group = (x[stays] for x in (h, part, c, n, top, group))
            if not len(h):
                last = None
                continue
            first = np.concatenate([[True], group[1:] != group[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            hub = [c[at], n[at], top[at]]
            if goes_on:
                hub = [np.where(group == 0, x, y) for x, y in zip(last[3:], hub)]
            yield pa.record_batch(dict(zip((*names, "hub", "hub_n", "hub_top"), (h, part, c, n, top, *hub))))
            last = (*latest, hub[0][-1], hub[1][-1], hub[2][-1]) if open_end else None

    return (
        entries.select("cls", "n", "prefix").where("n > 0")
        .mapInArrow(deal, "h long, part long, cls long, n long, top long")
        .repartition("h", "part")
        .sortWithinPartitions("h", "part", "cls")
        .mapInArrow(choose, "h long, part long, cls long, n long, top long, hub long, hub_n long, hub_top long")
    )


def _overlaps(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n_words: int, percent: int, hot: np.ndarray) -> DataFrame:
    """Exact links among pairs (a, b) of classes: partial overlaps per fragment, summed per pair.

    Texts are those of their classes' first rows, by doc_id and th."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    n_pairs = pairs.count()
    ids = wanted.join(reps.select("cls", "doc_id", "th"), "cls").select("cls", F.col("doc_id").alias("id"), F.col("th").alias("of"))
    ids = materialise(ids, "wanted", work=2 * n_pairs + reps.count())
    small = F.broadcast(ids) if (n_ids := ids.count()) <= BROADCAST_IDS else ids.hint("shuffle_hash")
    texts = docs.select("doc_id", "th", "text").join(small, (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("cls", "text")
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, steps = shared.value, np.arange(1, FRAGMENTS - 1, dtype=np.uint64) * np.uint64(2**64 // (FRAGMENTS - 1))
        for batch in batches:
            cls, rows = batch.column("cls").to_pylist(), ([], [], [], [])
            for c, s in zip(cls, shingle_sets(batch.column("text"), n_words)):
                often = np.zeros(len(s), bool)
                if len(known):
                    often = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                rare = s[~often]
                for f, seg in enumerate([*np.split(rare, np.searchsorted(rare, steps)), s[often]]):
                    for out, x in zip(rows, (c, f, len(s), _S(seg))):
                        out.append(x)
            yield pa.record_batch(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64()))],
                names=["cls", "fragment", "n", "segment"],
            )

    cuts = materialise(texts.mapInArrow(cut, "cls long, fragment int, n long, segment array<long>"), "fragments", work=10 * n_ids + reps.count())
    a = cuts.select(F.col("cls").alias("a"), "fragment", F.col("n").alias("na"), F.col("segment").alias("sa"))
    b = cuts.select(F.col("cls").alias("b"), "fragment", F.col("n").alias("nb"), F.col("segment").alias("sb"))
    partial = pairs.join(a, "a").join(b, ["b", "fragment"]).select(
        "a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).alias("common")
    )
    # repeated rows give the same fragment again
    partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    links = materialise(
        summed.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common", "na", "nb"), "links", work=n_pairs
    )
    discard(cuts, ids)
    return links


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) * 64 > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches (cls, n, sketch) folded to a quarter: short rows for comparison in blocks, where
    most sets have nothing in common."""
    for batch in batches:
        width = [max(64, _sketch_bits(n) // 4) for n in batch.column("n").to_pylist()]
        short = [_fold(np.frombuffer(x, np.uint64), w).tobytes() if x else x for x, w in zip(batch.column("sketch").to_pylist(), width)]
        yield pa.record_batch({"cls": batch.column("cls"), "sketch": pa.array(short, pa.binary())})


def _allowed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that their sizes and sketches allow to be links."""
    for batch in batches:
        keep = []
        for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in ("na", "nb", "sa", "sb"))):
            width = min(_sketch_bits(m), _sketch_bits(n))
            x, y = (_fold(np.frombuffer(z, np.uint64), width) for z in (x, y))
            least = -(-percent * (m + n) // (100 + percent))
            keep.append(int(np.bitwise_count(x ^ y).sum()) <= m + n - 2 * least)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, bi, bj), cut into batches of whole units with the column start: whether a
    unit begins there.  A unit has two blocks at most."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        held += [batch] if batch is not None and batch.num_rows else []
        if not held:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = [rows.column(k).to_numpy() for k in ("h", "bi", "bj")]
        start = np.concatenate([[True], (np.stack([x[1:] != x[:-1] for x in key])).any(0)])
        cut = rows.num_rows if batch is None else int(np.flatnonzero(start)[-1])
        held = rows.slice(cut).to_batches()
        if cut:
            yield from rows.slice(0, cut).append_column("start", pa.array(start[:cut])).combine_chunks().to_batches()


def _allowed_by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per unit: its left and right rows, and which pairs of them lie in different components and
    in each other's bounds."""
    n, top, comp, own, bi, bj = (batch.column(k).to_numpy() for k in ("n", "top", "component", "own", "bi", "bj"))
    edges = np.append(np.flatnonzero(batch.column("start").to_numpy(zero_copy_only=False)), batch.num_rows)
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows = np.arange(x, y)
        i, j = rows[own[x:y] == bi[x]], rows[own[x:y] == bj[x]]
        ok = (n[i][:, None] <= top[j]) & (n[j] <= top[i][:, None]) & (comp[i][:, None] != comp[j])
        yield i, j, np.triu(ok, 1) if bi[x] == bj[x] else ok


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of units that have a partner there."""
    for batch in _units(batches):
        keep = np.zeros(batch.num_rows, bool)
        for i, j, ok in _allowed_by_size(batch):
            keep[i[ok.any(1)]] = True
            keep[j[ok.any(0)]] = True
        yield batch.drop_columns("start").filter(pa.array(keep))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b), taken in order, join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    joins = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y], joins[k] = x, True
    return joins


def _residual(batches: Iterator[pa.RecordBatch], percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, bi, bj): pairs (a, b) of a unit that bounds and sketches allow; with
    forest only the most alike ones that join its components to trees, and a row (h, bi, bj) for
    each unit that has more."""
    for batch in _units(batches):
        cls, n, comp, h, bi, bj = (batch.column(k).to_numpy() for k in ("cls", "n", "component", "h", "bi", "bj"))
        sketches = [np.frombuffer(x, np.uint64) for x in batch.column("sketch").to_pylist()]
        found, rest = [], []
        for i, j, ok in _allowed_by_size(batch):
            folded: dict[tuple[int, int], np.ndarray] = {}
            at_i, at_j, apart = [], [], []
            for k in np.flatnonzero(ok.any(1)).tolist():
                x, ys = i[k], j[ok[k]]
                y_width = np.array([len(sketches[y]) for y in ys.tolist()])
                for w in np.unique(y_width).tolist():  # sizes this close differ by one doubling at most
                    y, width = ys[y_width == w], min(w, len(sketches[x])) * 64
                    for z in (x, *y.tolist()):
                        if (z, width) not in folded:
                            folded[z, width] = _fold(sketches[z], width)
                    d = np.bitwise_count(np.stack([folded[z, width] for z in y.tolist()]) ^ folded[x, width]).sum(1, dtype=np.int64)
                    both = n[x] + n[y]
                    near = d <= both + 2 * (-percent * both // (100 + percent))
                    at_i.append(np.full(int(near.sum()), x))
                    at_j.append(y[near])
                    apart.append(d[near] / both[near])
            if at_i:
                x, y = np.concatenate(at_i), np.concatenate(at_j)
                if forest:
                    order = np.argsort(np.concatenate(apart), kind="stable")
                    x, y = x[order], y[order]
                    joins = _forest(comp[x], comp[y])
                    if not joins.all():
                        rest.append(i[0])
                    x, y = x[joins], y[joins]
                found.append((cls[x], cls[y]))
        if found:
            x, y = (np.concatenate(z) for z in zip(*found))
            p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            more = len(rest)
            yield pa.record_batch(
                {
                    "a": pa.array(p[:, 0].tolist() + [None] * more, pa.int64()), "b": pa.array(p[:, 1].tolist() + [None] * more, pa.int64()),
                    "h": pa.array([None] * len(p) + h[rest].tolist(), pa.int64()),
                    "bi": pa.array([None] * len(p) + bi[rest].tolist(), pa.int32()), "bj": pa.array([None] * len(p) + bj[rest].tolist(), pa.int32()),
                }
            )


def _merged(edges: DataFrame) -> DataFrame:
    """Components of a materialised table of edges, materialised."""
    n = edges.count()
    return materialise(connected_components(edges, rows=n), "components", 2 * n)


def _solve(docs: DataFrame, n_words: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, th, text): their classes (doc_id, th, n, cls), a row per class (cls, n and the
    doc_id and th of its first row), links (a, b, common, na, nb) and components (cls, component)
    of classes that have links.  All are written; what they were made from is deleted."""
    small_batches(docs.sparkSession)
    hot, hot_count = _frequent(docs, n_words)
    table, parts = _signatures(docs, n_words, percent, hot, hot_count)
    table, reps = _classes(table)
    groups = materialise(_hubs(table, parts, percent), "groups")
    stars = groups.where("cls <> hub AND n <= hub_top AND hub_n <= top").select("cls", "hub")
    if parts:  # hubs of the parts of one shingle meet too
        heads = groups.where("part > 0 AND cls = hub")
        least = heads.groupBy("h").agg(F.min("cls").alias("top"))
        stars = stars.unionByName(heads.drop("top").join(least, "h").where("cls <> top").select("cls", F.col("top").alias("hub")))
    pairs = materialise(
        stars.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), "pairs"
    )
    n_pairs, n_reps = pairs.count(), reps.count()
    side = lambda k: reps.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda it: _allowed(it, percent), "a long, b long")
    likely = materialise(likely, "likely", work=n_pairs + n_reps)
    links = _overlaps(docs, reps, likely, n_words, percent, hot)
    merged = _merged(links.select("a", "b"))

    # groups with several components; for every link each class counts as one of its own
    unit_order = lambda df: df.repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj", "cls")
    into = lambda df, key: df.join(bounded_broadcast(merged.select(F.col("node").alias(key), F.col("component").alias("now"))), key, "left")
    member = groups.select("h", "cls", "n", "top")
    member = member.withColumn("component", F.col("cls")) if every else into(member, "cls").withColumn("component", F.coalesce("now", "cls")).drop("now")
    open_ = member.groupBy("h").agg(
        F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("top").alias("tops"),
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"),
    )
    # shingles of one passage often have the same members: the first in the order, with the widest
    # bounds, is enough
    open_ = open_.where("lo < hi").groupBy("size", "x", "y").agg(F.max_by("h", "tops").alias("h"))
    open_ = open_.select("h", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_ = materialise(open_, "open", groups.count())
    spent = [table, reps, groups, pairs, likely, open_]
    n_held = open_.agg(F.sum(F.col("blocks") * F.col("size"))).first()[0] or 0
    held = member.join(open_.drop("size"), "h").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    held = held.withColumn(
        "unit",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("bi"), F.greatest(k, F.col("own")).alias("bj")))),
    )
    unit = "h long, bi int, bj int, cls long, n long, top long, component long, own int"
    held = held.select("h", "unit.bi", "unit.bj", "cls", "n", "top", "component", "own")
    brief = reps.select("cls", "n", "sketch").mapInArrow(_brief, "cls long, sketch binary")
    for forest in (False,) if every else (True, False):
        held = materialise(unit_order(held).mapInArrow(_with_partners, unit), "units", work=n_held)
        proposed = unit_order(held.join(brief, "cls")).mapInArrow(
            lambda it, forest=forest: _residual(it, percent, forest), "a long, b long, h long, bi int, bj int"
        )
        units, proposed = held, materialise(proposed, "proposed", work=n_held + n_reps)
        more = proposed.where("a IS NOT NULL").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        more = materialise(more, "pairs", proposed.count() + pairs.count())
        spent += [units, proposed, more, merged]
        if not more.limit(1).count() and not forest:
            break
        links = links.unionByName(_overlaps(docs, reps, more, n_words, percent, hot))
        known = merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
        merged = _merged(known.unionByName(links.select("a", "b")))
        rest = bounded_broadcast(proposed.where("a IS NULL").select("h", "bi", "bj"))
        held = into(held.join(rest, ["h", "bi", "bj"], "left_semi"), "component").withColumn("component", F.coalesce("now", "component")).select(*held.columns)
        pairs = pairs.unionByName(more)
    rows = materialise(table.select("doc_id", "th", "n", "cls"), "documents", work=table.count())
    classes = materialise(reps.select("cls", "n", "doc_id", "th"), "classes", work=n_reps)
    # what is left reads none of these
    discard(*(t for t in spent if t is not merged))
    return rows, classes, links, merged.select(F.col("node").alias("cls"), "component")


def _with_hash(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with th, which tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def ngram_links(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, rep, component), links between representatives (a, b, common, na, nb)
    and components (node, component) of those that have links.

    A representative is the least doc_id of the documents with equal shingle sets.  With every, all
    links between representatives are given, else enough for the components (see the module).
    Null text counts as empty; empty texts link with nothing; rows with a null doc_id take part but
    can't be representatives unless all copies are null (then the ends of their links are null; a
    component goes by its least doc_id, null if none has one); repeated doc_ids are rows of their
    own; other columns are ignored.
    """
    table, reps, links, merged = _solve(_with_hash(docs), n_words, percent, every)
    # from here a class goes by its least doc_id
    named = lambda df, k: df.withColumnRenamed(k, "cls").join(reps.select("cls", F.col("doc_id").alias(k)), "cls").drop("cls")
    links = named(named(links, "a"), "b")
    merged = merged.join(reps.select("cls", F.col("doc_id").alias("node")), "cls")
    least = merged.groupBy("component").agg(F.min("node").alias("least"))
    merged = merged.join(least, "component").select("cls", "node", F.col("least").alias("component"))
    components = merged.where("node IS NOT NULL").select("node", "component")
    documents = table.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(
        reps.select("cls", F.col("doc_id").alias("rep")), "cls"
    ).join(merged.select("cls", "component"), "cls", "left")
    return documents, links, components


def ngram_components(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included.

    Empty texts (null, or without a word) have n_shingles 0 and their own doc_id.  An empty table
    gives no rows.  Very long texts are read whole.
    """
    out, _, _ = ngram_links(docs, n_words, percent)
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def near_dedup(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, with all columns: of each component one row stays, that of the smallest doc_id.

    Rows, not ids, stay or go: rows that share a doc_id each by their text, and a row with a null
    doc_id stays only where no row with one is in its component.  Rows equal in doc_id and text
    become one, unless they are empty: texts without words all stay.  Other columns may have any
    names; an empty table gives no rows.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("th"))
    table, reps, _, merged = _solve(_with_hash(docs), n_words, percent, False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    # classes by their first rows; of each component the first class
    named = reps.where("n > 0").join(merged, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    best = named.groupBy("component").agg(first.alias("best"))
    keeper = named.join(best, "component").select("cls", "best")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    seen = table.where("n > 0").groupBy("doc_id", "th", "cls").agg(F.count("*").alias("copies"))
    seen = seen.join(keeper, "cls").select(F.col("doc_id").alias("id"), F.col("th").alias("of"), "copies", (own == F.col("best")).alias("stays"))
    marks = materialise(seen.where("NOT stays OR copies > 1"), "dropped", table.count())
    same = (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    gone = marks.where("NOT stays").select("id", "of")
    left = rows.join(bounded_broadcast(gone), same, "left_anti")
    if not (again := marks.where("stays").select("id", "of")).limit(1).count():
        return left.select("row.*")
    # rows that stay and repeat: one of each, by a partial aggregate
    left = left.join(bounded_broadcast(again), same, "left")
    once = left.where("of IS NOT NULL").groupBy("doc_id", "th").agg(F.first("row").alias("row"))
    return left.where("of IS NULL").select("row.*").unionByName(once.select("row.*"))
