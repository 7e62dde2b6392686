"""Which members of groups to compare: each with its group's hub, or all with each other in tiles.

The hub of a group is its most central member, the one that shares most groups
with most others; comparing with it costs as many comparisons as there are
members.  For what that leaves unconnected, a group's members outside its largest
component are to be compared with all its others.  Members are dealt by hash to
blocks of about ``BLOCK``; a tile is a pair of blocks, so a group of any size is
spread over many tasks and none holds more than two blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut
from linkloom.llm.components import connected

BLOCK = 256


def shared(rows: DataFrame) -> DataFrame:
    """The rows (group, node) of groups of several nodes, with the group's size n; written."""
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("group", "n")
    return cut(rows.join(sizes, "group").select("group", "node", "n"))


def centrality(rows: DataFrame) -> DataFrame:
    """(node, weight): how many members the groups of each node have together."""
    return rows.groupBy("node").agg(F.sum("n").alias("weight"))


def hubs_of(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, a): the hub of each group; with its component c, if rows have comp."""
    hub = F.max_by(F.struct(*(c for c in ("node", "comp") if c in rows.columns)), F.struct("weight", "node"))
    hubs = rows.join(weights, "node").groupBy("group").agg(hub.alias("hub"))
    return hubs.select("group", F.col("hub.node").alias("a"), *([F.col("hub.comp").alias("c")] if "comp" in rows.columns else []))


def hubbed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of several nodes, and the groups' hubs; both written."""
    met = shared(rows)
    return met, cut(hubs_of(met, centrality(met)))


def hub_pairs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of the hub and another node of each group; only of other components than the hub's, if
    rows have comp: a link within one joins nothing."""
    apart = "comp <> c" if "comp" in rows.columns else "node <> a"
    return rows.join(hubs, "group").where(apart).select("a", F.col("node").alias("b")).distinct()


def mixed_groups(rows: DataFrame) -> DataFrame:
    """The rows (group, node, comp) of groups that hold several components.  Of groups with equal members one is left."""
    kinds = rows.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.count("*").alias("n")).where("lo < hi")
    chosen = kinds.groupBy("x", "n").agg(F.min("group").alias("group")).select("group")
    return rows.join(chosen, "group", "left_semi").select("group", "node", "comp")


def joined_groups(rows: DataFrame) -> DataFrame:
    """Groups (group, node, comp) that share nodes made one, so that each node is in one group; written."""
    rows = cut(rows)
    hubs = rows.groupBy("group").agg(F.min("node").alias("a"))
    group = connected(cut(rows.join(hubs, "group").select("a", F.col("node").alias("b")).distinct())).withColumnRenamed("comp", "group")
    return cut(rows.select("node", "comp").distinct().join(group, "node").select("group", "node", "comp"))


def tiles(members: DataFrame) -> DataFrame:
    """(group, p, q, side, node, comp): the members (group, node, comp) of every tile; side 0 is block p, side 1 block q > p."""
    sizes = members.groupBy("group", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("group").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    apart = F.col("comp") != F.col("main")
    # blocks by hash: those outside the main component from 0, those inside from where the former end
    outside, inside = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    slot = F.pmod(F.xxhash64("node"), F.when(apart, outside).otherwise(inside)).cast("int") + F.when(apart, 0).otherwise(outside)
    placed = cut(members.join(main, "group").select("group", "node", "comp", slot.alias("block"), outside.alias("outside"), (outside + inside).alias("blocks")))
    # tiles (p, q) with p outside the main component and p <= q
    firsts = F.sequence(F.lit(0), F.least(F.col("block"), F.col("outside") - 1))
    as_second = placed.select("*", F.explode(firsts).alias("p")).select("group", "p", F.col("block").alias("q"), F.when(F.col("p") == F.col("block"), 0).otherwise(1).alias("side"), "node", "comp")
    seconds = placed.where("block < outside and block + 1 < blocks").select("*", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("q"))
    return as_second.unionByName(seconds.select("group", F.col("block").alias("p"), "q", F.lit(0).alias("side"), "node", "comp"))
