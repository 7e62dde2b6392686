"""Undirected graphs of edges (a, b): vertices, components, paths and local structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.paths import totals
from linkloom.operators.relations import both_ways
from linkloom.plans.loops import cut, ranked


def vertices(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """Persons with defaults, and endpoints that no person stands for with their id alone."""
    ends = both_ways(edges).select(F.col("node").alias("id")).distinct().withColumn("endpoint", F.lit(True))
    return persons.join(ends, "id", "full").select("id", "name", F.coalesce("role", F.lit("outro")).alias("role"), F.coalesce("status", F.lit("rascunho")).alias("status"), F.coalesce("endpoint", F.lit(False)).alias("connected"))


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, comp): comp is the smallest node reachable.

    Labels spread along edges and then jump to their own labels, so rounds grow with the logarithm of the
    longest path; every round is written and read back.  No join is a broadcast, which would send all labels through
    the driver in every round.
    """
    keys = keys or []
    near = cut(both_ways(edges, *keys).distinct())
    labels = cut(near.groupBy(*keys, "node").agg(F.least(F.min("other"), F.min("node")).alias("comp")))
    while True:
        seen = near.join(labels.withColumnRenamed("node", "other").hint("merge"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("comp").alias("near"))
        low = labels.join(seen.hint("merge"), [*keys, "node"]).withColumn("low", F.least("comp", "near"))
        root = labels.select(*keys, F.col("node").alias("low"), F.col("comp").alias("further"))
        new = cut(low.join(root.hint("merge"), [*keys, "low"], "left").select(*keys, "node", F.least("low", F.coalesce("further", "low")).alias("new"), "comp"))
        labels = new.select(*keys, "node", F.col("new").alias("comp"))
        if not new.where("new < comp").limit(1).count():
            return labels


def numbered(comps: DataFrame) -> DataFrame:
    """(node, comp, number, size): components numbered from 0 by falling size, then smallest node."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    return comps.join(ranked(sizes, "number", F.desc("size"), "comp"), "comp").select("node", "comp", "number", "size")


def hops(edges: DataFrame, origins: DataFrame | None = None, most: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, origin, node, hops): breadth-first distances from the origins (column node; all nodes by default).

    Each round extends the frontier by one hop and drops what was reached before.
    """
    keys = keys or []
    near = cut(both_ways(edges, *keys).distinct())
    starts = near.select(*keys, "node").distinct() if origins is None else origins.select(*keys, "node").distinct()
    reached = cut(starts.select(*keys, F.col("node").alias("origin"), "node", F.lit(0).alias("hops")))
    frontier, step = reached, 0
    while most is None or step < most:
        step += 1
        ahead = frontier.join(near, [*keys, "node"]).select(*keys, "origin", F.col("other").alias("node")).distinct()
        frontier = cut(ahead.join(reached, [*keys, "origin", "node"], "left_anti").withColumn("hops", F.lit(step)))
        if not frontier.limit(1).count():
            break
        reached = cut(reached.unionAll(frontier))
    return reached


def largest(comps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node) of the largest component (of each key), of equal ones that of the smallest node.

    Found by maxima over the components' sizes, never by a sort of all of them in one task.
    """
    keys = keys or []
    sizes = comps.groupBy(*keys, "comp").agg(F.count("*").alias("size"))
    top = sizes.groupBy(*keys).agg(F.max("size").alias("size"))
    tied = sizes.join(top, [*keys, "size"]) if keys else sizes.join(top, "size")
    chosen = tied.groupBy(*keys).agg(F.min("comp").alias("comp"))
    return comps.join(chosen, [*keys, "comp"], "left_semi").select(*keys, "node")


def path_totals(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pairs, total, diameter) over the ordered pairs of the largest component."""
    keys = keys or []
    main = largest(components(edges, keys), keys)
    return totals(edges.join(main.withColumnRenamed("node", "a"), [*keys, "a"], "left_semi"), keys)


def density(edges: Column, nodes: Column) -> Column:
    return F.when(nodes > 1, 2.0 * edges / (nodes * (nodes - 1))).otherwise(0.0)


def triangles(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each triangle once, as (keys, x, y, z) with x < y < z."""
    keys = keys or []
    on = [*keys, "node"]
    degree = both_ways(edges, *keys).groupBy(*on).agg(F.count("*").alias("k"))
    # each edge leads to its end of more neighbours: so no node has more than the root of twice the edges ahead
    both = edges.select(*keys, "a", "b").join(degree.withColumnsRenamed({"node": "a", "k": "ka"}), [*keys, "a"]).join(degree.withColumnsRenamed({"node": "b", "k": "kb"}), [*keys, "b"])
    less = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    e = cut(both.select(*keys, F.when(less, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("ka", "kb").alias("k")))
    ahead = e.select(*keys, "x", F.col("y").alias("z"), F.col("k").alias("kz"))
    two = e.join(ahead, [*keys, "x"]).where("k < kz OR (k = kz AND y < z)")
    closed = e.select(*keys, F.col("x").alias("y"), F.col("y").alias("z"))
    three = two.select(*keys, "x", "y", "z").join(closed, [*keys, "y", "z"]).withColumn("s", F.array_sort(F.array("x", "y", "z")))
    return three.select(*keys, *(F.col("s")[i].alias(c) for i, c in enumerate("xyz")))


def clustering(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, degree, triangles, coefficient) of connected nodes; degree 1 gives 0."""
    keys = keys or []
    t = triangles(edges, keys)
    on = t.select(*keys, F.explode(F.array("x", "y", "z")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("t"))
    d = both_ways(edges, *keys).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    n, k = F.coalesce("t", F.lit(0)), F.col("degree")
    return d.join(on, [*keys, "node"], "left").select(*keys, "node", "degree", n.cast("long").alias("triangles"), F.when(k < 2, 0.0).otherwise(2.0 * n / (k * (k - 1))).alias("coefficient"))


def ego(edges: DataFrame, center: int, radius: int = 2) -> DataFrame:
    """Edges among the nodes within radius hops of center, with the hops of both ends."""
    spark = edges.sparkSession
    present = both_ways(edges).where(F.col("node") == center).select("node").limit(1)
    around = hops(edges, present if present.count() else spark.createDataFrame([], "node long"), radius).select("node", "hops")
    out = edges.join(around.withColumnsRenamed({"node": "a", "hops": "hops_a"}), "a").join(around.withColumnsRenamed({"node": "b", "hops": "hops_b"}), "b")
    return out.select("a", "b", "weight20", "hops_a", "hops_b")
