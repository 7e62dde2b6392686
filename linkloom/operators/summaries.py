"""Summaries of whole networks that are several figures side by side: by type, by decade, around origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import period as P
from linkloom.functions import text as X
from linkloom.functions import vocab as V
from linkloom.operators import graph, paths
from linkloom.operators import relations as R
from linkloom.plans.loops import cut


def basis_points(a: Column, b: Column) -> Column:
    """Share in basis points, rounded down; null without a base."""
    return F.when(b > 0, F.floor(a * 10000 / b).cast("long"))


def by_type(relations: DataFrame) -> DataFrame:
    """A row for each type of relation, also those without any: its relations and the network that it alone makes."""
    r = cut(relations)
    e = cut(R.collapse(r, ["type"]))
    degree = R.both_ways(e, "type").groupBy("type", "node").agg(F.count("*").alias("degree"))
    nodes = degree.groupBy("type").agg(F.count("*").alias("nodes"))
    best = R.top(degree, 5, ["type"], F.desc("degree"), "node")
    top = best.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node", "degree"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["degree"].cast("string"))), ",").alias("top5"))
    edges = e.groupBy("type").agg(F.count("*").alias("edges"))
    comps = graph.components(e, ["type"]).groupBy("type", "comp").agg(F.count("*").alias("size")).groupBy("type").agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    c = graph.clustering(e, ["type"]).groupBy("type").agg((F.sum("triangles") / 3).cast("long").alias("triangles"), F.floor(F.avg("coefficient") * 10000).cast("long").alias("clustering_bp"))
    count = lambda name: F.count_if(F.col("confidence") == name).alias(name)
    rel = r.groupBy("type").agg(F.count("*").alias("relations"), *map(count, V.CONFIDENCES), F.count_if(F.col("period") != "").alias("with_period"))
    out = r.sparkSession.createDataFrame([(t,) for t in V.RELATION_TYPES], "type string")
    for part in (rel, nodes, edges, comps, c, top):
        out = out.join(part, "type", "left")
    zeros = ("relations", *V.CONFIDENCES, "with_period", "nodes", "edges", "components", "largest", "triangles", "clustering_bp")
    out = out.select("type", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in zeros), F.coalesce("top5", F.lit("")).alias("top5"))
    return out.withColumns({"density": graph.density(F.col("edges"), F.col("nodes")), "with_period_bp": basis_points(F.col("with_period"), F.col("relations"))})


def by_decade(relations: DataFrame) -> DataFrame:
    """Active and cumulative networks of every decade, all in one pass with the decade as key."""
    iv = P.effective(P.parse(F.col("period")))
    r = cut(X.fixed(relations, *relations.columns, iv=iv).select("*", "iv.first", "iv.last").where("first is not null").drop("iv"))
    bounds = r.agg(P.decade(F.min("first")).alias("lo"), P.decade(F.max("last")).alias("hi"))
    decades = bounds.where("lo <= hi").select(F.explode(F.sequence("lo", "hi", F.lit(10))).alias("decade"))
    # decades are few: a century has ten
    active = r.join(F.broadcast(decades), (F.col("first") <= F.col("decade") + 9) & (F.col("last") >= F.col("decade"))).withColumn("mode", F.lit("active"))
    total = r.join(F.broadcast(decades), F.col("first") <= F.col("decade") + 9).withColumn("mode", F.lit("cumulative"))
    keys = ["decade", "mode"]
    both = active.unionAll(total)
    e = cut(R.collapse(both, keys))
    comps = graph.components(e, keys).groupBy(*keys, "comp").agg(F.count("*").alias("size")).groupBy(*keys).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    near = graph.clustering(e, keys).groupBy(*keys).agg(F.count("*").alias("nodes"), F.floor(F.avg("coefficient") * 10000).cast("long").alias("clustering_bp"))
    out = e.groupBy(*keys).agg(F.count("*").alias("edges")).join(near, keys).join(comps, keys).join(both.groupBy(*keys).agg(F.count("*").alias("relations")), keys)
    return out.select(*keys, "relations", "nodes", "edges", "components", "largest", graph.density(F.col("edges"), F.col("nodes")).alias("density"), "clustering_bp")


def reach(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, hops_1, hops_2, hops_3, reachable) of the origins (node) that have edges; other origins count as reached."""
    at = lambda k: F.count_if(F.col("hops") == k).alias(f"hops_{k}")
    return graph.hops(edges, origins).where("hops > 0").groupBy("origin").agg(at(1), at(2), at(3), F.count("*").alias("reachable"))


def convergence(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """One row: the pairs of others that a path connects, and those with a shortest path through an origin (node)."""
    e, o = cut(edges), cut(origins)
    return paths.through(e, o, cut(graph.hops(e, o)))
