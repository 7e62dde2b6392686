"""Benchmark decontamination by SimHash windows.

Each benchmark item gets a 256-bit SimHash over its 5-word shingles.  Texts are
searched with windows of exactly the items' lengths; window fingerprints come from
prefix sums over the shingles' signed bits.  A multi-index over ``BLOCKS`` blocks
of 32 bits lets through the items of the window's length that some block shows
within RADIUS // BLOCKS bits, so by the pigeonhole principle no item within
``RADIUS`` bits is missed; of unrelated pairs it passes under 1 %.  Candidates are
verified by the exact weighted Jaccard similarity of the shingle multisets.  A
shingle of an item weighs ln(1 + M / n) where n of all M items have it, one that
only the window has weighs ln(1 + M).

Only windows that share a shingle with an item of their length are looked at;
any other window has similarity 0 with every item, so nothing is lost.

Weights are counted over the whole benchmark.  A task holds a block of at most about
``ITEM_BYTES`` of items.  If there are several blocks, one scan of all documents
keeps those that share any shingle with any item, by a bitmap of at most
``FILTER_BITS`` that has no false negatives, and the blocks are sought in these.
The results don't depend on the blocks.

Defined results: null or empty texts and items match nothing.  An item of fewer
than five words matches its exact word sequence.  Of all windows of a text and an
item the most similar one is reported, the first among equals.  A text shorter
than an item is compared as a whole.  Very long texts are searched whole, in runs
of windows.  Repeated rows are reported each; equal items of one id count once, an
id with several texts stands for each of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import Batches, HashTable, cut, map_arrow

WORDS = 5
SIMILARITY = 0.75
#: Of pairs at the similarity, 0.1 % have fingerprints farther apart.
RADIUS, BLOCKS = 63, 8
ITEM_BYTES = 4 << 20
FILTER_BITS = 1 << 28
SLICE = 1 << 17
#: Windows whose sums are taken together, and pairs of windows and items compared at once.
RUN, PAIRS = 4096, 1 << 18
U64 = np.uint64
_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)
_LANES = np.arange(1, 5, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)


def _word_hashes(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[s.codes]
    w = K.words(low, s.bounds)
    return K.span_hashes(low, w.starts, w.ends), w.counts


def signed_bits(g: np.ndarray) -> np.ndarray:
    """256 votes of each shingle, +1 or -1."""
    wide = K.mix(g[:, None] + _LANES[None, :])
    return np.unpackbits(wide.view(np.uint8).reshape(len(g), 32), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as four words each, of summed votes."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1, 4)


def within(prints: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
    """(window, item, bits apart) of all pairs of fingerprints within RADIUS; a pair is looked at where some block is near."""
    out, step = [], max(1, PAIRS // max(1, len(own)))
    for lo in range(0, len(prints), step):
        apart = np.bitwise_count((prints[lo : lo + step, None, :] ^ own[None, :, :]).view(np.uint32))  # by block
        w, i = np.nonzero((apart <= RADIUS // BLOCKS).any(axis=2))
        total = apart[w, i].sum(axis=1, dtype=np.int64)
        ok = total <= RADIUS
        out += zip((w[ok] + lo).tolist(), i[ok].tolist(), total[ok].tolist(), strict=True)
    return out


class Item:
    """An item's distinct shingles, sorted, with how often it and how many items have them."""

    def __init__(self, ident: int, words: int, g: np.ndarray, df: np.ndarray, all_items: int):
        self.ident, self.words = ident, words
        self.kinds, self.times = np.unique(g, return_counts=True)
        self.weights = np.log1p(all_items / df)
        self.heaviest = float(np.log1p(all_items))
        self.fingerprint = packed(signed_bits(g).sum(axis=0, keepdims=True))[0]

    def similarity(self, window: np.ndarray) -> float:
        u, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(self.kinds, u), len(self.kinds) - 1)
        own = self.kinds[at] == u
        times = np.zeros(len(self.kinds), dtype=np.int64)
        times[at[own]] = n[own]
        return float((self.weights * np.minimum(times, self.times)).sum() / ((self.weights * np.maximum(times, self.times)).sum() + self.heaviest * int(n[~own].sum())))


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, items: list[Item], short: dict[int, dict[int, list[int]]]):
        self.short = short  # words -> hash -> items
        self.items = items
        self.table = HashTable(np.unique(np.concatenate([x.kinds for x in items] or [np.zeros(0, np.uint64)])))
        lengths: list[set[int]] = [set() for _ in range(len(self.table.hashes))]  # of the items with each shingle
        by_size = defaultdict(list)
        for i, x in enumerate(items):
            by_size[x.words].append(i)
            for k in self.table.find(x.kinds).tolist():
                lengths[k].add(x.words)
        self.lengths = [sorted(x) for x in lengths]
        self.index = {n: (members, np.stack([items[i].fingerprint for i in members])) for n, members in by_size.items()}

    def search(self, h: np.ndarray, g: np.ndarray, hits: np.ndarray, entries: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item id, first word, words, similarity, bits apart) of the best window of each item in one text.

        h: word hashes, g: shingle hashes, hits: shingle positions found in the table, entries: where.
        """
        wanted: dict[int, list[int]] = defaultdict(list)
        for p, e in zip(hits.tolist(), entries.tolist(), strict=True):
            for n in self.lengths[e]:
                wanted[n].append(p)
        best: dict[int, tuple[float, int, int, int]] = {}
        for n, at in wanted.items():
            size = min(n, len(h))
            last, wide = len(h) - size, size - WORDS + 1
            edge = np.zeros(last + 2, dtype=np.int64)
            p = np.array(at)
            np.add.at(edge, np.maximum(0, p - wide + 1), 1)
            np.add.at(edge, np.minimum(p, last) + 1, -1)
            begin = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            members, own = self.index[n]
            # runs of starts that lie apart are summed apart, long runs in stretches
            cuts = np.flatnonzero(np.diff(begin) > 4 * size) + 1
            for run in (r[k : k + RUN] for r in np.split(begin, cuts) for k in range(0, len(r), RUN)):
                lo, hi = run[0], run[-1] + wide
                sums = np.zeros((hi - lo + 1, 256), dtype=np.int32)
                np.cumsum(signed_bits(g[lo:hi]), axis=0, out=sums[1:])
                prints = packed(sums[run - lo + wide] - sums[run - lo])
                for w, k, apart in within(prints, own):
                    s, i = int(run[w]), members[k]
                    similar = self.items[i].similarity(g[s : s + wide])
                    if similar >= SIMILARITY and (i not in best or (similar, -s) > (best[i][0], -best[i][1])):
                        best[i] = (similar, s, size, apart)
        return [(self.items[i].ident, s, size, similar, apart) for i, (similar, s, size, apart) in sorted(best.items())]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(text, item id, first word, words, similarity, bits apart) over an array of texts."""
        for s in K.slices(texts, SLICE):
            h, counts = _word_hashes(s)
            first = np.concatenate(([0], np.cumsum(counts)))
            g = K.ngram_hashes(h, WORDS)
            if len(g):
                owner = np.repeat(np.arange(len(counts)), counts)
                entry = self.table.find(g)
                at = np.flatnonzero((entry >= 0) & (owner[: len(g)] == owner[WORDS - 1 :]))
                cuts = np.searchsorted(owner[at], np.arange(len(counts) + 1)) if len(at) else np.zeros(len(counts) + 1, int)
                for t in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = first[t], first[t + 1]
                    mine = at[cuts[t] : cuts[t + 1]]
                    for found in self.search(h[a:b], g[a : b - WORDS + 1], mine - a, entry[mine]):
                        yield (s.first + t, *found)
            for n, known in self.short.items():
                q = K.ngram_hashes(h, n)
                owner = np.repeat(np.arange(len(counts)), counts)
                seen = set()
                for p in np.flatnonzero(np.isin(q, np.array(list(known), dtype=np.uint64))).tolist():
                    t = int(owner[p])
                    if t == owner[p + n - 1]:
                        for item in known[int(q[p])]:
                            if (t, item) not in seen:
                                seen.add((t, item))
                                yield (s.first + t, item, p - int(first[t]), n, 1.0, 0)


def _features(batches: Batches) -> Batches:
    """(row, id, n, g): the words and the shingles, in order, of each item; a shorter one has one hash."""
    for batch in batches:
        rows, ids, sizes, lists = [], [], [], []
        for s in K.slices(batch.column("t")):
            h, counts = _word_hashes(s)
            first = np.concatenate(([0], np.cumsum(counts)))
            for i, n in enumerate(counts.tolist()):
                if n:
                    rows.append(batch.column("row")[s.first + i].as_py())
                    ids.append(batch.column("id")[s.first + i].as_py())
                    sizes.append(n)
                    lists.append(K.ngram_hashes(h[first[i] : first[i + 1]], min(n, WORDS)).view(np.int64))
        g = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32()), pa.array(np.concatenate(lists) if lists else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), g], names=["row", "id", "n", "g"])


def _blocks(items: DataFrame, count: int, all_items: int) -> Iterator[Items]:
    """The items, block by block, with their shingles' counts over all of them."""
    long = items.where(F.col("n") >= WORDS)
    kinds = long.select("row", F.explode(F.array_distinct("g")).alias("s"))
    df = cut(kinds.groupBy("s").agg(F.count("*").alias("df")))
    counted = cut(kinds.join(df, "s").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "df"))).alias("kinds")))
    dealt = items.join(counted, "row", "left").select("row", "id", "n", "g", F.col("kinds.s").alias("s"), F.col("kinds.df").alias("df"))
    for k in range(count):
        rows = dealt.where(F.pmod("row", F.lit(count)) == k).orderBy("id", "row").toArrow()
        out, short = [], defaultdict(lambda: defaultdict(list))
        for r in range(rows.num_rows):
            ident, n, g, s, n_items = (rows[c][r] for c in ("id", "n", "g", "s", "df"))
            shingles = np.array(g.values, dtype=np.int64).view(np.uint64)
            if n.as_py() < WORDS:
                short[n.as_py()][int(shingles[0])].append(ident.as_py())
            else:
                order = np.argsort(np.array(s.values, dtype=np.int64).view(np.uint64))
                out.append(Item(ident.as_py(), n.as_py(), shingles, np.array(n_items.values, dtype=np.int64)[order], all_items))
        yield Items(out, {n: dict(x) for n, x in short.items()})


class Filter:
    """A bitmap of shingles with two bits each: what it doesn't hold, no item has."""

    def __init__(self, hashes: np.ndarray, short: list[tuple[int, int]]):
        bits = min(FILTER_BITS.bit_length() - 1, max(10, int(64 * (len(hashes) + 1)).bit_length()))
        self.shift, self.map = U64(64 - bits), np.zeros(1 << bits - 3, dtype=np.uint8)
        self.short = sorted({n for n, _ in short})
        for x in (hashes, np.array([h for _, h in short], dtype=np.uint64)):
            for y in self._places(x):
                np.bitwise_or.at(self.map, y >> U64(3), _BIT[y & U64(7)])

    def _places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return K.mix(x + U64(1)) >> self.shift, K.mix(x + U64(2)) >> self.shift

    def holds(self, x: np.ndarray) -> np.ndarray:
        a, b = (self.map[y >> U64(3)] & _BIT[y & U64(7)] for y in self._places(x))
        return (a > 0) & (b > 0)

    def touched(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a shingle of the bitmap."""
        out = np.zeros(len(texts), dtype=bool)
        for s in K.slices(texts, SLICE):
            h, counts = _word_hashes(s)
            owner = np.repeat(np.arange(len(counts)), counts) + s.first
            for n in (WORDS, *self.short):
                g = K.ngram_hashes(h, n)
                at = np.flatnonzero(self.holds(g))
                out[owner[at][owner[at] == owner[at + n - 1]]] = True
        return out


def _candidates(source: DataFrame, items: DataFrame, count: int) -> DataFrame:
    """The rows of source that share a shingle, or the sequence of a short item, with any item; written."""
    hashes, short = [], []
    for k in range(count):
        rows = items.where(F.pmod("row", F.lit(count)) == k).select(F.col("n") < WORDS, "n", F.explode("g")).distinct().toArrow()
        g, few, n = rows[2].to_numpy().view(np.uint64), rows[0].to_numpy(), rows[1].to_numpy()
        hashes.append(g[~few])
        short += zip(n[few].tolist(), g[few].tolist(), strict=True)
    known = Filter(np.unique(np.concatenate(hashes)), short)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array(known.touched(batch.column("t"))))

    return cut(map_arrow(source, run, source.schema))


_FOUND = "doc_id long, item_id long, first_word long, n_words long, similarity double, bits_apart long"


def _scan(source: DataFrame, items: Items) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = list(items.scan(batch.column("t")))
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=["doc_id", "item_id", "first_word", "n_words", "similarity", "bits_apart"])

    return map_arrow(source, run, _FOUND)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity, bits_apart: the best window of every document and item that match."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    told = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("t is not null and id is not null").distinct()
    items = cut(map_arrow(told.select(F.xxhash64("id", "t").alias("row"), "id", "t"), _features, "row long, id long, n long, g array<long>"))
    size = items.agg(F.sum("n"), F.count(F.when(F.col("n") >= WORDS, 1))).collect()[0]
    count = max(1, -(-6 * (size[0] or 0) // ITEM_BYTES))  # a word and its blank are taken for six bytes
    blocks = _blocks(items, count, size[1])
    if count == 1:
        return _scan(source, next(blocks))
    source, out = _candidates(source, items, count), None
    for block in blocks:
        part = cut(_scan(source, block))
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item.  Rows of a null id can't be named as contaminated and stay;
    all rows of an id go with any of them."""
    gone = find(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == F.col("__gone"), "left_anti")
