"""Conflict-constrained best-fit packing of documents into training sequences.

Documents become pieces of at most ``capacity`` tokens.  A bin holds pieces up to
its capacity, at most one piece of a source and one of a cluster of duplicates;
it carries both sets as bitmaps.  Pieces are placed longest first into the bin of
the smallest sufficient residual that is compatible; the search goes on to the
successor residuals until it finds one, else it opens a bin.

The bins of a shard hang on a segment tree over residuals.  A node holds the
bitmaps that all bins below it share, so whole ranges of incompatible bins are
passed over and the search stays exact.

Shards are dealt by a hash of the id, in proportion to the input (at most about
``SHARD_ROWS`` documents each), whatever source or cluster is common.  Documents
of one cluster in different shards are in different bins anyway.  Their number is
a power of two, so a growing input is packed anew only when it has doubled.

Defined results: a null or empty text has no words and makes one piece of one
token (its end).  Null sources and null ids conflict with nothing.  Clusters are
by default the equal texts after folding case and blanks; a frame (doc_id,
cluster_id), such as near-duplicate groups, may be given instead.  Equally long
pieces go by doc_id, then piece, then text hash; of equal residuals the bin that
was opened first is taken.  Rows that repeat an id are documents of their own.
Very long texts become as many pieces as they need, each in a bin of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.native import WORD

CAPACITY = 2048
SHARD_ROWS = 2048


class Bins:
    """Open bins by residual, with shared bitmaps for every range of residuals."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.shared: list[tuple[int, int] | None] = [None] * (2 * self.size)  # None: no bin below
        self.at: list[list[int]] = [[] for _ in range(self.size)]  # bins of each residual, in order of opening
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _refresh(self, residual: int) -> None:
        s = c = -1
        for b in self.at[residual]:
            s &= self.sources[b]
            c &= self.clusters[b]
        k = residual + self.size
        self.shared[k] = (s, c) if self.at[residual] else None
        k //= 2
        while k:
            a, b = self.shared[2 * k], self.shared[2 * k + 1]
            self.shared[k] = b if a is None else a if b is None else (a[0] & b[0], a[1] & b[1])
            k //= 2

    def find(self, need: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(residual, bin) of the tightest compatible bin."""

        def below(k: int, lo: int, hi: int) -> tuple[int, int] | None:
            shared = self.shared[k]
            if hi < need or shared is None or shared[0] & source or shared[1] & cluster:
                return None
            if lo == hi:
                for b in self.at[lo]:
                    if not self.sources[b] & source and not self.clusters[b] & cluster:
                        return lo, b
                return None
            mid = (lo + hi) // 2
            return below(2 * k, lo, mid) or below(2 * k + 1, mid + 1, hi)

        return below(1, 0, self.size - 1)

    def place(self, need: int, capacity: int, source: int, cluster: int) -> int:
        found = self.find(need, source, cluster)
        if found is None:
            residual, b = capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            residual, b = found
            self.at[residual].remove(b)
            self._refresh(residual)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = residual - need
        low = self.at[left]
        k = len(low)
        while k and low[k - 1] > b:
            k -= 1
        low.insert(k, b)
        self._refresh(left)
        return b


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bins, from 0, of pieces (tokens, source, cluster) in the order given, which should be by falling tokens.

    None is no source or cluster.  Only what occurs twice needs a bit.
    """
    bits: list[dict] = [{}, {}]
    for k in (1, 2):
        seen: set = set()
        for p in pieces:
            if p[k] is not None and p[k] in seen:
                bits[k - 1].setdefault(p[k], 1 << len(bits[k - 1]))
            seen.add(p[k])
    bins = Bins(capacity)
    return [bins.place(n, capacity, bits[0].get(s, 0), bits[1].get(c, 0)) for n, s, c in pieces]


def assign(docs: DataFrame, capacity: int = CAPACITY, clusters: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin (shard and number in it), source, cluster_id: one row for each piece.

    Tokens are the text's words and one end.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    folded = F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), (F.regexp_count(t, F.lit(WORD)) + 1).cast("long").alias("tokens"), F.xxhash64(t).alias("print"),
        # a frame of clusters can't name rows without an id: only those are told by their texts then
        F.when(F.lit(clusters is None) | F.col(doc_id).isNull(), F.when(folded != "", F.xxhash64(folded))).alias("own"),
    )
    shards = 1 << max(0, (docs.count() - 1) // SHARD_ROWS).bit_length()
    if clusters is None:
        base = base.withColumnRenamed("own", "cluster_id")
    else:
        given = clusters.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("cluster_id").cast("long").alias("cluster_id")).dropDuplicates(["doc_id"])
        base = base.join(given, "doc_id", "left").withColumn("cluster_id", F.coalesce("own", "cluster_id"))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "print"), F.lit(shards)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "print", "tokens", "source", "cluster_id")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        pieces = []
        for i, (_, _, tokens, _, _) in enumerate(got):
            for k, at in enumerate(range(0, tokens, capacity)):
                pieces.append((min(capacity, tokens - at), i, k, at))
        pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
        # the pieces of one document conflict with each other by its cluster, or by themselves
        bins = pack([(n, got[i][3], got[i][4] if got[i][4] is not None else ("own", i)) for n, i, _, _ in pieces], capacity)
        of = lambda f, kind: pa.array([f(*p) for p in pieces], kind)
        return pa.table(
            {
                "doc_id": of(lambda n, i, k, at: got[i][0], pa.int64()), "piece": of(lambda n, i, k, at: k, pa.int64()),
                "first_token": of(lambda n, i, k, at: at, pa.int64()), "n_tokens": of(lambda n, i, k, at: n, pa.int64()),
                "bin": pa.array([(shard << 32) + b for b in bins], pa.int64()),
                "source": of(lambda n, i, k, at: got[i][3], pa.string()), "cluster_id": of(lambda n, i, k, at: got[i][4], pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, first_token long, n_tokens long, bin long, source string, cluster_id long")


def summary(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, bins, and the share of the bins' capacity that is filled."""
    out = assigned.agg(F.count("*").alias("pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count_distinct("bin").alias("bins"))
    return out.withColumn("fill", F.when(F.col("bins") > 0, F.col("tokens") / (F.col("bins") * capacity)))
