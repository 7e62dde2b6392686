"""Hard negatives by exact inner-product search over one-dimensional distance keys.

Vectors become integers, floor(256 * x).  A further component, the root of the largest
squared length less the vector's own, makes the largest inner product with an anchor the
smallest distance from it.  Each vector is keyed by its nearest pivot and its distance
from that, the rows are stored in the order of the keys, in blocks of ``BLOCK``, and a
directory has the keys each block spans at each pivot.

By the triangle inequality a row at distance r of an anchor has a key within r of the
anchor's own distance from the row's pivot.  So a search scans key intervals: first
those around the anchors' own keys, then, once k rows are found, the annuli out to the
distance of the k-th, beyond which nothing can be better.  Where fewer are found
the interval grows until it holds all keys.  An answer is given once it
is certified so; it is exact, however many rows have to be scanned for it.

Anchors are taken in groups of ``GROUP`` that lie close together in the order of keys.
A group of anchors meets a block of rows in one task, as a matrix product; neither
grows with the input.  Best rows are merged by anchor, at most k from each block.

Defined results: rows with a null label or vector or a component that is null or not
finite take no part; a row without an id can be a positive or a negative, after its
ties, and no anchor; rows of the anchor's own id aren't its positives; of repeated rows
each counts; vectors of unequal lengths are compared as if zeros followed the shorter;
products beyond 64 bits are clamped.  Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Batches, bounded_sample, cut, map_arrow
from linkloom.plans.loops import ranked

BLOCK, GROUP = 4096, 1024
#: Groups of anchors that meet a block in one task.
GROUPS_PER_TASK = 4
#: Pivots: one for so many rows, at most MOST_PIVOTS, fitted on at most SAMPLE rows.
ROWS_PER_PIVOT, MOST_PIVOTS, SAMPLE = 512, 64, 4096
#: Anchors whose scores against a block are worked out at once.
STRIP = 256
NO_ID = np.iinfo(np.int64).max
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integral(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", moved: int = 7, labels: int = 10, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vec): the rows that take part, with integer components; labels of ids divisible by moved go on by one."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    i, k = F.col(vec_id).cast("long"), F.col(label).cast("long")
    return rows.where(x.isNotNull() & k.isNotNull() & finite).select(
        i.alias("vec_id"), F.when(i % moved == 0, (k + 1) % labels).otherwise(k).alias("label"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("vec")
    )


def matrix(vecs: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows, zeros behind the shorter."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    n = np.asarray(vecs.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), dtype=np.int64)
    starts = np.cumsum(n) - n
    out[np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(starts, n)] = vecs.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b, clamped to 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    largest = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (a, b)]
    if largest[0] * largest[1] * width < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


def _lifted(vecs: np.ndarray, longest: float) -> np.ndarray:
    """vecs with the component that makes all equally long; longest is the largest squared length."""
    v = vecs.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))[:, None]])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = pivots.shape[1]
    points = np.pad(points, ((0, 0), (0, max(0, width - points.shape[1]))))
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def fit_pivots(sample: np.ndarray, longest: float, n: int, rounds: int = 8, seed: int = 12) -> np.ndarray:
    """Centres of the lifted sample, by k-means from rows drawn by the seed."""
    points = _lifted(sample, longest)
    centres = points[np.random.default_rng(seed).choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        centres = np.stack([points[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres


class Index:
    """Rows (vec_id, label, vec, block) stored by key, the directory (block, pivot, lo, hi) of their blocks, and the pivots."""

    def __init__(self, rows: DataFrame):
        rows = cut(rows.withColumn("__length", F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
        facts = rows.agg(F.count("*").alias("n"), F.max("__length").alias("longest"), F.max(F.size("vec")).alias("width")).first()
        self.n, self.longest, self.width = facts["n"], float(facts["longest"] or 0), int(facts["width"] or 0)
        pivots = max(1, min(MOST_PIVOTS, self.n // ROWS_PER_PIVOT))
        sample = pa.array([r["vec"] for r in bounded_sample(rows.select("vec_id", "vec"), "vec_id", SAMPLE).collect()], pa.list_(pa.int64()))
        self.pivots = fit_pivots(matrix(sample, self.width), self.longest, pivots) if self.n else np.zeros((1, self.width + 1))
        placed = cut(ranked(self._keyed(rows.select("vec_id", "label", "vec"), stored=True), "place", "pivot", "key", F.col("vec_id").asc_nulls_last()))
        self.rows = placed.select("vec_id", "label", "vec", (F.col("place") / BLOCK).cast("long").alias("block"))
        self.directory = cut(placed.groupBy((F.col("place") / BLOCK).cast("long").alias("block"), "pivot").agg(F.min("key").alias("lo"), F.max("key").alias("hi")))

    def _keyed(self, rows: DataFrame, stored: bool) -> DataFrame:
        """rows with their nearest pivot and the distance from it; a query isn't lifted."""
        longest, width, pivots = self.longest, self.width, self.pivots

        def run(batches: Batches) -> Batches:
            for batch in batches:
                vecs = matrix(batch.column("vec"), width)
                away = _distances(_lifted(vecs, longest) if stored else vecs.astype(np.float64), pivots)
                near = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(away[np.arange(len(near)), near])], names=[*batch.schema.names, "pivot", "key"])

        return map_arrow(rows, run, f"{_ddl(rows)}, pivot int, key double")

    def grouped(self, anchors: DataFrame) -> DataFrame:
        """anchors (vec_id, label, vec) with a number a, by which near ones follow each other, and their group g; written."""
        placed = ranked(self._keyed(anchors, stored=False), "a", "pivot", "key", "vec_id")
        return cut(placed.select("a", (F.col("a") / GROUP).cast("long").alias("g"), "vec_id", "label", "vec"))

    def _asked(self, anchors: DataFrame) -> DataFrame:
        """(g, block): the blocks with keys within some anchor's radius; without a radius, those around the anchor's own key."""
        width, pivots = self.width, self.pivots
        slack = 1e-3 + 1e-6 * float(np.sqrt(self.longest))

        def run(batches: Batches) -> Batches:
            for batch in batches:
                away = _distances(matrix(batch.column("vec"), width).astype(np.float64), pivots)
                radius = batch.column("radius").to_numpy(zero_copy_only=False)[:, None]
                home = away.argmin(axis=1)[:, None] == np.arange(away.shape[1])
                reach = np.where(radius >= 0, radius + slack, np.where(home, slack, np.nan))
                a, p = np.nonzero(~np.isnan(reach))
                g = batch.column("g").to_numpy()[a]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(p, pa.int32()), pa.array((away - reach)[a, p]), pa.array((away + reach)[a, p])], names=["g", "pivot", "from", "to"])

        spans = map_arrow(anchors.select("g", "vec", "radius"), run, "g long, pivot int, from double, to double").groupBy("g", "pivot").agg(F.min("from").alias("from"), F.max("to").alias("to"))
        return spans.join(self.directory, "pivot").where("from <= hi AND to >= lo").select("g", "block").distinct()

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(a, w, score, id): for each window w (from, to) of an anchor its k best rows in it, of its label or (not same) of others.

        anchors: a, g, vec_id, label, vec and windows, an array of (w, from, to).  Written.
        """
        longest = self.longest
        found = scanned = None
        # bounds: for each window the k-th best score so far, or where the window starts
        state = cut(anchors.withColumn("bounds", F.transform("windows", lambda w: w["from"])).withColumn("radius", F.lit(-1.0)).withColumn("sure", F.lit(False)))
        wide, far = 0.5 * float(np.sqrt(longest)), 4.0 * float(np.sqrt(longest)) + 1.0
        while True:
            asked = cut(self._asked(state) if scanned is None else self._asked(state).join(scanned, ["g", "block"], "left_anti"))
            if scanned is None or not asked.isEmpty():
                best = _scan(state, self.rows, asked, k, same)
                best = best if found is None else best.unionByName(found)
                place = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id"))
                found = cut(best.withColumn("place", place).where(F.col("place") <= k).drop("place"))
                scanned = asked if scanned is None else cut(scanned.unionByName(asked))
            if state.where("NOT sure").isEmpty():
                return found
            kth = found.groupBy("a", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kths"))
            joined = anchors.join(kth, "a", "left").join(state.select("a", F.col("radius").alias("was")), "a")
            bounds = F.transform("windows", lambda w: F.greatest(w["from"], F.coalesce(F.element_at("kths", w["w"]), w["from"])))
            # no row beyond this distance of the anchor reaches the least of its bounds; without bounds the interval grows, at last to all keys
            least = F.array_min("bounds")
            own = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
            certain = F.sqrt(F.greatest(F.lit(0.0), own + F.lit(longest) - 2.0 * least.cast("double")))
            radius = F.when(least > _LEAST, certain).when(F.col("was") < 0, wide).otherwise(far)
            state = cut(joined.withColumn("bounds", bounds).withColumn("sure", (least > _LEAST) | (F.col("was") >= 0)).withColumn("radius", radius).drop("kths", "was"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _scan(anchors: DataFrame, rows: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(a, w, score, id): the rows of the blocks asked for that may be among the k best of a window, at most k from a block."""
    task = (F.col("g") / GROUPS_PER_TASK).cast("long").alias("task")
    left = asked.select("g", "block", task).join(anchors.select("g", "a", "vec_id", "label", "vec", "windows", "bounds"), "g").drop("g")
    right = asked.select("block", task).distinct().join(rows, "block").select(F.col("block").alias("of"), F.col("task").alias("by"), "vec_id", "label", "vec")

    def run(key: tuple, asks: pa.Table, held: pa.Table) -> pa.Table:
        parts = list(_best(asks, held, k, same))
        join = lambda i, kind: pa.array(np.concatenate([p[i] for p in parts]) if parts else [], kind)
        return pa.table({"a": join(0, pa.int64()), "w": join(1, pa.int32()), "score": join(2, pa.int64()), "id": join(3, pa.int64())})

    return left.groupBy("block", "task").cogroup(right.groupBy("of", "by")).applyInArrow(run, "a long, w int, score long, id long")


def _best(asks: pa.Table, held: pa.Table, k: int, same: bool):
    """(a, w, score, id) of the rows in question, by strips of anchors."""
    if not asks.num_rows or not held.num_rows:
        return
    ids = held["vec_id"].fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, labels, vecs = ids[order], held["label"].to_numpy()[order], matrix(held["vec"], 0)[order]
    for at in range(0, asks.num_rows, STRIP):
        part = asks.slice(at, STRIP)
        own, kinds = part["vec_id"].to_numpy(), part["label"].to_numpy()
        scores = products(matrix(part["vec"], 0), vecs)
        fit = (kinds[:, None] == labels) & (own[:, None] != ids) if same else kinds[:, None] != labels
        windows, bounds, numbers = part["windows"].to_pylist(), part["bounds"].to_pylist(), part["a"].to_numpy()
        for w in range(max((len(x) for x in windows), default=0)):
            has = np.array([len(x) > w for x in windows])
            low = np.array([b[w] if len(b) > w else 0 for b in bounds], dtype=np.int64)
            high = np.array([x[w]["to"] if len(x) > w else 0 for x in windows], dtype=np.int64)
            name = np.array([x[w]["w"] if len(x) > w else 0 for x in windows], dtype=np.int32)
            may = fit & has[:, None] & (scores >= low[:, None]) & (scores <= high[:, None])
            many = np.flatnonzero(may.sum(axis=1) > k)
            if len(many):
                ranked_ = np.where(may[many], scores[many], _LEAST)
                may[many] &= scores[many] >= np.partition(ranked_, -k, axis=1)[:, -k][:, None]
            a, b = np.nonzero(may)  # by anchor, then by id
            s = scores[a, b]
            by = np.lexsort((b, -s.astype(np.float64), a)) if len(s) and np.abs(s.astype(np.float64)).max() < 2**53 else np.array(sorted(range(len(a)), key=lambda i: (a[i], -int(s[i]), b[i])), dtype=np.int64)
            a, b, s = a[by], b[by], s[by]
            first = np.searchsorted(a, a)
            top = np.arange(len(a)) - first < k
            yield numbers[a[top]], name[a[top]], s[top], ids[b[top]]


def window_of(positive: str, least: int, most: int) -> tuple[Column, Column]:
    """The whole scores s with least * positive <= 100 * s <= most * positive, from and to; without overflow."""
    whole, rest = F.expr(f"({positive} - pmod({positive}, 100)) div 100"), F.pmod(F.col(positive), F.lit(100))
    return whole * least + F.ceil(rest * least / 100).cast("long"), whole * most + F.floor(rest * most / 100).cast("long")


def mine(
    rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows ask, a condition on vec_id and label as they take part (by default those whose id is divisible
    by 100).  Each anchor's positives are its best rows of the same label; for each of them its best rows of other
    labels are returned whose score is from least to most hundredths of the positive's.
    """
    index = Index(integral(rows, vec_id, vector, label))
    asking = index.rows.drop("block").where("vec_id IS NOT NULL").where(F.col("vec_id") % 100 == 0 if anchors is None else anchors)
    asking = index.grouped(asking)
    window = lambda w, a, b: F.struct(w.cast("int").alias("w"), a.cast("long").alias("from"), b.cast("long").alias("to"))
    everything = asking.withColumn("windows", F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST))))
    near = index.search(everything, positives, same=True)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    near = cut(near.select("a", F.col("id").alias("positive"), F.col("score").alias("positive_score"), place.alias("w")))
    start, end = window_of("positive_score", least, most)
    asked = near.withColumn("from", start).withColumn("to", end).where("from <= to").groupBy("a").agg(F.array_sort(F.collect_list(window(F.col("w"), F.col("from"), F.col("to")))).alias("windows"))
    far = index.search(asking.join(asked, "a"), negatives, same=False)
    order = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = far.withColumn("rank", order).join(near, ["a", "w"]).join(asking.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", named("positive").alias("positive_id"), "rank", named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
