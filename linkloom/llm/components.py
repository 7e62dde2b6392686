"""Connected components of links between integer nodes.

One level deals with links in two steps: every task reduces its links to stars
(a smallest node and the nodes it reaches), then stars are dealt by node, where
the roots that share a node meet.  What remains is a graph among roots alone,
which the next level takes, with as many fewer partitions.  A node turns up at
most once for each run of ``ROWS_PER_TASK`` links, so no node draws many rows to
one task, and both steps hold about that many rows however many links there are.
Every level is written to the checkpoint folder; labels join back from the last
level to the first.

Defined results: no links give no rows; repeated links, both directions of one
and links of a node to itself change nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Batches, cut, map_arrow

ROWS_PER_TASK, LEAST_TASKS = 200_000, 6


def _top(place: dict[int, int], x: int) -> int:
    while place[x] != x:
        place[x] = place[place[x]]
        x = place[x]
    return x


def _forest(a: list[int], b: list[int]) -> dict[int, int]:
    place: dict[int, int] = {}
    for x, y in zip(a, b, strict=True):
        p, q = _top(place, place.setdefault(x, x)), _top(place, place.setdefault(y, y))
        if p != q:
            place[max(p, q)] = min(p, q)
    return place


def _stars(batches: Batches) -> Batches:
    """(node, root) of the forest of each run of links."""
    a, b = [], []

    def star() -> pa.RecordBatch:
        place = _forest(a, b)
        nodes = list(place)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_top(place, n) for n in nodes], pa.int64())], names=["node", "root"])

    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= ROWS_PER_TASK:
            yield star()
            a, b = [], []
    yield star()


def _meet(batches: Batches) -> Batches:
    """(node, root, upper): the smallest root of each node dealt here; upper rows are links among roots."""
    node, root = [], []
    for batch in batches:
        node += batch.column(0).to_pylist()
        root += batch.column(1).to_pylist()
    place = _forest(node, root)
    own = [(n, _top(place, n), False) for n in set(node)]
    upper = [(r, t, True) for r in set(root) if (t := _top(place, r)) != r]
    columns = list(zip(*own, *upper, strict=True)) if own else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["node", "root", "upper"])


def connected(links: DataFrame, count: int | None = None) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node reachable.

    links should be a written table: it is counted, if its count isn't given.
    """
    count = links.count() if count is None else count
    parts = max(LEAST_TASKS, -(-4 * count // ROWS_PER_TASK))
    stars = map_arrow(links.select("a", "b"), _stars, "node long, root long")
    met = cut(map_arrow(stars.repartition(parts, "node"), _meet, "node long, root long, upper boolean"))
    labels, upper = met.where("not upper").select("node", "root"), met.where("upper").select(F.col("node").alias("a"), F.col("root").alias("b"))
    left = upper.count()
    if not left:
        return labels.withColumnRenamed("root", "comp")
    higher = connected(upper.coalesce(max(1, -(-left // ROWS_PER_TASK))), left).withColumnRenamed("node", "root")
    return labels.join(higher, "root", "left").select("node", F.coalesce("comp", "root").alias("comp"))
