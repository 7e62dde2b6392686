"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct 5-word shingles.  Two small
collections of ``HALVES`` half keys each (``ROWS`` minhashes to a half key) stand
for HALVES * HALVES tables: the key of table (i, j) pairs half key i of the first
with half key j of the second.  So 2 * HALVES * ROWS minhashes do the work of
HALVES**2 * 2 * ROWS.  A pair of similarity 0.75 shares no table with probability
2 * (1 - 0.75**3)**20 = 3e-5; all that share one are compared on their full sets.

1. Documents with equal sets form a class, named by the fingerprint of its set.
2. Half keys that only one class has are dropped: a shared table needs both
   halves shared.
3. In the tables that pair half keys of equal index, each class is compared with
   the most central one of its table.  That connects most of what is alike with a
   number of comparisons in proportion to the classes.  A half key whose classes
   are all connected is dropped with all its tables.
4. In all tables that are left, classes are compared with their tables' most
   central ones again.
5. Classes that still share any of the tables across components are compared with
   each other in tiles; only what joins components is emitted.

Full sets are made again from the texts of the classes that share half keys, so no
other set is ever stored.

Defined results: a document without words (or null) has an empty set, is linked
with nothing and kept.  One with fewer than five words has one shingle, its whole
sequence.  Very long texts count whole.  Rows of a null id are never linked; their
component is null and they are kept.  Rows that repeat an id are each labelled by
their own text's group.  Of documents of one group the one of the smallest id is
kept, and all rows of that id and group are.  Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import kernels as K
from linkloom.llm.common import Batches, attach, cut, map_arrow
from linkloom.llm.components import connected
from linkloom.llm.tiles import centrality, hub_pairs, hubs_of, joined_groups, mixed_groups, shared, tiles

WORDS = 5
ROWS, HALVES = 3, 20
#: 100 * intersection >= PERCENT * union
PERCENT = 75
SLICE = 1 << 17
U64 = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64) * U64(2) + U64(1)

_KEYS = T.ArrayType(T.LongType())


def _sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice the sorted distinct shingles, text by text, and where each text's start."""
    for s in K.slices(texts, SLICE):
        low = K.LOWER[s.codes]
        w = K.words(low, s.bounds)
        g, owner = K.shingles(K.span_hashes(low, w.starts, w.ends), w.counts, WORDS)
        n = len(w.counts)
        first = np.searchsorted(owner, np.arange(n + 1))
        parts = [np.unique(g[first[i] : first[i + 1]]) for i in range(n)]
        yield (np.concatenate(parts) if parts else g), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _print(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each set."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=np.uint64)
    some = n > 0
    if some.any():
        out[some] = K.mix(np.add.reduceat(K.mix(g), first[:-1][some]) + n[some].astype(np.uint64))
    return out


def _signatures(texts: pa.Array) -> list[pa.Array]:
    """Set size, fingerprint of the set, and the half keys of both collections."""
    sizes, prints, keys = [], [], []
    for g, first in _sets(texts):
        n = np.diff(first)
        some = n > 0
        at = first[:-1][some]
        out = np.zeros((len(n), 2 * HALVES), dtype=np.uint64)
        if len(at):
            for k in range(2 * HALVES):
                half = np.full(len(at), k + 1, dtype=np.uint64)
                for r in range(ROWS):
                    half = K.mix(half * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(g * _FACTORS[k * ROWS + r], at))
                out[some, k] = half & ~U64(63) | U64(k)  # the lowest bits tell a half key's place
        sizes.append(n)
        prints.append(_print(g, first))
        keys.append(out)
    if not sizes:
        return [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))]
    n, fp, half = np.concatenate(sizes), np.concatenate(prints), np.concatenate(keys)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * HALVES)), pa.array(half.view(np.int64).ravel()))
    return [pa.array(n, pa.int64()), pa.array(fp.view(np.int64)), lists]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _similar(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def _verify(batches: Batches) -> Batches:
    """Pairs (a, b) whose sets sa and sb are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            keep.append(_similar(_shared(p, q), len(p), len(q)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _close(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets' sizes don't rule similarity out."""
    na, nb = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    return pairs.join(na, "a").join(nb, "b").where(F.greatest("na", "nb") * PERCENT <= F.least("na", "nb") * 100).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are confirmed on full sets."""
    sa, sb = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return map_arrow(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb"), _verify, "a long, b long")


def _with_components(halves: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The half keys (node, key, comp) at which classes of different components meet."""
    if comps is None:
        return halves.withColumn("comp", F.col("node"))
    own = halves.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return own.join(mixed, "key", "left_semi")


def _tables(halves: DataFrame, diagonal: bool) -> DataFrame:
    """Table keys (group, node, comp) from the half keys that are left; a class has at most HALVES on each side."""
    both = halves.groupBy("node", "comp").agg(F.collect_list("key").alias("h"))
    place = lambda x: x.bitwiseAND(F.lit(63))
    left, right = F.filter("h", lambda x: place(x) < HALVES), F.filter("h", lambda x: place(x) >= HALVES)
    met = lambda x: F.filter(right, lambda y: (place(y) == place(x) + HALVES) if diagonal else F.lit(True))
    paired = F.flatten(F.transform(left, lambda x: F.transform(met(x), lambda y: F.xxhash64(x, y))))
    return both.select(F.explode(paired).alias("group"), "node", "comp")


def _compare_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the two blocks of a tile (or within one) that join different components."""
    node, comp, side = (rows[c].to_numpy() for c in ("node", "comp", "side"))
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows["set"]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if key[1].as_py() == key[2].as_py() else 1))
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    seen, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    used = times[column] > 1  # shingles of one class alone add nothing to any intersection
    dense = np.cumsum(times > 1) - 1
    column, owner = dense[column[used]], owner[used]
    shared = np.zeros((len(left), len(right)))
    place = np.full(len(sets), -1)
    width = 4096
    for lo in range(0, int((times > 1).sum()), width):
        at = (column >= lo) & (column < lo + width)
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[owner[at], column[at] - lo] = 1
        shared += m[left] @ m[right].T
    union = n[left][:, None] + n[right][None, :] - shared
    x, y = np.nonzero((100 * shared >= PERCENT * union) & (comp[left][:, None] != comp[right][None, :]))
    place = {c: c for c in np.unique(comp).tolist()}

    def top(c: int) -> int:
        while place[c] != c:
            place[c] = place[place[c]]
            c = place[c]
        return c

    out = []
    for i, j in zip(left[x].tolist(), right[y].tolist(), strict=True):
        p, q = top(int(comp[i])), top(int(comp[j]))
        if p != q:
            place[max(p, q)] = min(p, q)
            out.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def _sets_of(nodes: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """(node, set) of classes, made from the texts of their smallest ids and written."""
    wanted = classes.select("node", "id").join(nodes, "node", "left_semi")
    held = _full_sets(source.join(wanted.select("id").distinct(), "id", "left_semi"))
    return cut(held.join(wanted.select("node"), held["fp"] == wanted["node"], "left_semi").select(F.col("fp").alias("node"), "set").dropDuplicates(["node"]))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, n, component) of every row: its id, a hash of its text, its set's size, its group."""
    fields = [T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", _KEYS)]
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = cut(attach(source.withColumn("h", F.xxhash64("text")), lambda: _signatures, fields, keep=["id", "h"]))
    # one class for each fingerprint
    classes = cut(signed.where("n > 0 and id is not null").groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("keys").alias("keys")))
    halves = shared(classes.select(F.explode("keys").alias("group"), "node"))
    weights = cut(centrality(halves))
    halves = halves.select(F.col("group").alias("key"), "node")
    sets = _sets_of(weights.select("node"), classes, source)
    links, comps = None, None
    for diagonal in (True, False):
        tables = cut(_tables(_with_components(halves, comps), diagonal))
        if comps is not None:
            tables = cut(mixed_groups(tables))
        pairs = cut(_close(hub_pairs(tables, hubs_of(tables, weights)), classes))
        new = _links(pairs, sets)
        links = cut(new if links is None else links.unionAll(new))
        comps = connected(links)
    members = mixed_groups(tables.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    members = joined_groups(members)
    if members.limit(1).count():
        links = cut(links.unionAll(tiles(members).join(sets, "node").groupBy("group", "p", "q").applyInArrow(_compare_blocks, "a long, b long")))
        comps = connected(links)
    joined = classes.select("node", "id").join(comps, "node")
    joined = joined.join(joined.groupBy("comp").agg(F.min("id").alias("component")), "comp").select("node", "component")
    own = classes.select("node", "id").join(joined, "node", "left").select(F.col("node").alias("fp"), F.coalesce("component", "id").alias("component"))
    out = signed.drop("keys").join(own, "fp", "left")
    return out.withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))).select("id", "h", "n", "component")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    out = _grouped(docs, doc_id, text)
    kept = F.col("id").isNull() | (F.col("component") == F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def _full_sets(docs: DataFrame) -> DataFrame:
    """id, fingerprint and the sorted set of each document, as bytes."""

    def columns(texts: pa.Array) -> list[pa.Array]:
        prints, blobs = [np.zeros(0, dtype=np.uint64)], []
        for g, first in _sets(texts):
            prints.append(_print(g, first))
            blobs += [g[first[i] : first[i + 1]].tobytes() for i in range(len(first) - 1)]
        return [pa.array(np.concatenate(prints).view(np.int64)), pa.array(blobs, pa.binary())]

    return attach(docs, lambda: columns, [T.StructField("fp", T.LongType()), T.StructField("set", T.BinaryType())], keep=["id"])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: the one of the smallest id.  Columns are docs' own.

    Rows go by id and text, so a row that shares its id with a copy of another document stays.
    """
    gone = _grouped(docs, doc_id, text).where("component <> id").select(F.col("id").alias("__gone"), F.col("h").alias("__h")).distinct()
    return docs.join(gone, (docs[doc_id].cast("long") == F.col("__gone")) & (F.xxhash64(docs[text].cast("string")) == F.col("__h")), "left_anti")
