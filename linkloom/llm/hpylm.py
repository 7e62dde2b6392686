"""Document scoring by a hierarchical Pitman-Yor trigram model.

Every context of two words has a restaurant, every context of one word has one,
and there is a root.  The restaurant of (u2, u1) shares the parent u1 with all
others that end in u1; the parent of u1 is the root, whose base is uniform over
the training vocabulary and one unknown word.  Restaurants are told apart by whole
words (64-bit hashes), so there are as many as the training texts have contexts.
A restaurant keeps for each word its customers and tables; each table is a
customer of the parent.  Tables are Gibbs-sampled given the customers: with
discount d and strength s the conditional of t tables for c customers is
proportional to

    S_d(c, t) * prod_{k<t} (s + d (T + k)) * p_parent(w)^t

(S_d: generalised Stirling numbers; T: the other tables of the restaurant).  It is
drawn exactly up to ``EXACT`` customers; what follows is seated by the
restaurant's rule in blocks of a sixteenth of those that sit.  Discounts are
estimated for each level from its counts of one and two.  The predictive
probabilities of the last ``SAMPLES`` of ``SWEEPS`` sweeps are averaged.  Each
sweep draws every level given the level above as the sweep before left it.

Data flow: one pass over the texts deals token occurrences, packed in arrays, to
buckets by the word before (u1), so that a bucket has the restaurants of u1 and of
all (u2, u1) to itself.  Buckets grow in number with the input.  A u1 that is too
common for one bucket is dealt by u2 over several, and its own restaurant, like
the root, is kept by word in separate buckets: a sweep sends these the customers
of each word and gets back customers and tables.  Only sums over whole
restaurants of that kind, bounded by ``COMMON``, pass through the driver.  Draws
are seeded by bucket and sweep: a lost task that runs again draws the same.

Defined results: a null text is an empty one; it has one token, its end.  Without
training tokens every probability is the uniform base.  Very long texts are
scored whole; their tokens are dealt like any others.  Rows are scored each,
repeated or null ids included.  Words count by 48-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import TIDY, Batches, bounded_sample, cut, drop_table, ensure_checkpoint_dir, let_go, map_arrow, settings

SWEEPS, SAMPLES = 3, 2
STRENGTH, EXACT = 1.0, 32
#: Tokens that a task packs together, and that a bucket holds in expectation; words in a bucket of words.
FLUSH_TOKENS, BUCKET_TOKENS, BUCKET_WORDS = 1_200_000, 2_000_000, 4_000_000
#: Tokens are dealt in so many shares, one after the other, so that only one is on disk twice, as dealt and as written.
SHARES = 2
#: Documents from which common words are told, and most of these; they only steer how tokens are dealt.
PROBE_DOCUMENTS, COMMON = 2000, 1000
SLICE = 1 << 18
U64 = np.uint64
START, END = U64(0x5354415254), U64(0x454E44454E44)


def _tokens(s: K.Slice, starts: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with ends, the words before and before those, and the tokens of each text.

    What stands before a text's start is one of so many restaurants of the same parent, by the id.
    """
    low = K.LOWER[s.codes]
    w = K.words(low, s.bounds)
    n = len(w.counts)
    out = np.full(len(w.starts) + n, END)
    out[np.arange(len(w.starts)) + w.text] = K.span_hashes(low, w.starts, w.ends) >> U64(16)
    counts = w.counts + 1
    first = np.cumsum(counts) - counts
    one, two = np.empty_like(out), np.empty_like(out)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[first] = START
    second = first[counts > 1] + 1
    two[second] = START
    two[first] = START + U64(1) + K.mix(ids.astype(np.uint64)) % U64(starts)
    return out, one, two, counts


def _probe(docs: DataFrame) -> tuple[float, dict[int, float]]:
    """Mean tokens of a document, and the shares of the most common words before others, from a bounded sample."""
    few = bounded_sample(docs.select("doc_id"), "doc_id", PROBE_DOCUMENTS).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi").select("text")

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for s in K.slices(batch.column("text"), SLICE):
                _, one, _, counts = _tokens(s, 1, np.zeros(len(s.bounds) - 1))
                u, n = np.unique(one, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n), pa.array([len(counts)] + [0] * (len(u) - 1), pa.int64())], names=["w", "n", "docs"])

    counted = map_arrow(rows, count, "w long, n long, docs long")
    sums = counted.agg(F.sum("n"), F.sum("docs")).collect()[0]
    tokens, seen = sums[0] or 0, sums[1] or 0
    top = counted.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(COMMON).collect() if tokens else []
    return tokens / max(seen, 1), {r["w"]: r["n"] / tokens for r in top}


def _keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash partitioning deals there."""
    place = F.pmod(F.hash(F.col("id")), F.lit(n))
    got = spark.range(30 * n + 100).groupBy(place.alias("p")).agg(F.min("id").alias("id")).collect()
    keys = {r["p"]: r["id"] for r in got}
    spare = 30 * n + 100  # for a partition that none of the numbers falls to: its bucket shares another's
    return np.array([keys.get(p, spare + p) for p in range(n)], dtype=np.int64)


class Plan(NamedTuple):
    """How tokens and words are dealt: common words (sorted hashes) with their parts, and the names of buckets."""

    common: np.ndarray
    parts: np.ndarray
    buckets: np.ndarray
    word_buckets: np.ndarray

    def word_bucket(self, words: np.ndarray) -> np.ndarray:
        return (K.mix(words) % U64(len(self.word_buckets))).astype(np.int64)

    def common_at(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the common ones, -1 for others."""
        if not len(self.common):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[at] == words, at, -1)


def small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after a byte that tells how many."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def large(blob: bytes) -> np.ndarray:
    """What small packed."""
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Counts or sorted hashes' steps, byte plane by byte plane, compressed."""
    planes, sizes = [], []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        width = max(1, -(-top.bit_length() // 8))
        planes.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        sizes += [len(x), width]
    raw = np.array([len(arrays), *sizes], dtype="<u4").tobytes() + b"".join(planes)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(blob: bytes | pa.Buffer) -> list[np.ndarray]:
    """What squeeze packed, as int64."""
    view = memoryview(blob)
    raw = pa.decompress(view[4:], int.from_bytes(view[:4], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<u4", count=2 * n, offset=4).reshape(n, 2).tolist()
    out, at = [], 4 + 8 * n
    for count, width in sizes:
        wide = np.zeros((count, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=count * width, offset=at).reshape(width, count).T
        out.append(wide.view("<i8").ravel())
        at += count * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


_PACKED = "bucket long, flush long, tokens binary, header binary"


def _deal(docs: DataFrame, plan: Plan, starts: int, share: int) -> DataFrame:
    """(bucket, flush, tokens, header): the occurrences of each bucket's contexts in one flush, packed.

    tokens: steps of the sorted dictionary and each word's times in it, from which its rank follows; then, document by
    document, the ranks of the words before, of those before these, and of the words; then the documents with their
    tokens.  A document is its place in the flush, doubled, plus one if it isn't learned from.  header, in one row of
    each flush, has the flush's ids, held flags and token counts.  share: of SHARES, by the buckets' names.
    """
    buckets = len(plan.buckets)
    mine_of = plan.buckets % SHARES == share

    def run(batches: Batches) -> Batches:
        base, serial = TaskContext.get().partitionId() << 32, 0
        pend: list[tuple] = []
        have = texts = 0

        def flush() -> pa.RecordBatch:
            t, one, two, counts = (np.concatenate([p[k] for p in pend]) for k in range(4))
            held = np.concatenate([p[5] for p in pend])
            bucket = K.mix(one) % U64(buckets)
            at = plan.common_at(one)
            hot = np.flatnonzero(at >= 0)
            bucket[hot] = (bucket[hot] + K.mix(two[hot] + U64(7)) % plan.parts[at[hot]].astype(np.uint64)) % U64(buckets)
            bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32)
            own = np.flatnonzero(mine_of[bucket])
            order = own[np.argsort(bucket[own], kind="stable")]
            owner = np.repeat((np.arange(len(counts)) * 2 + held).astype(np.uint16), counts)[order]
            bucket = bucket[order]
            # a text's words are the words before its later ones, so places in the flush's vocabulary are found once
            known, place = _runs(np.concatenate((t, START + np.arange(starts + 1, dtype=np.uint64))).view(np.int64))
            place, mark = place[: len(t)].astype(np.int32), place[len(t) :].astype(np.int32)
            first = np.cumsum(counts) - counts
            before, further = np.empty_like(place), np.empty_like(place)
            before[1:], further[2:] = place[:-1], place[:-2]
            before[first] = mark[0]
            further[first[counts > 1] + 1] = mark[0]
            further[first] = mark[(two[first] - START).astype(np.int64)]
            edges = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(order))
            rank, rows = np.empty(len(known), dtype=np.int32), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = order[a:b]
                codes = np.concatenate((before[mine], further[mine], place[mine]))
                sorted_ = np.sort(codes)
                new = np.flatnonzero(np.diff(sorted_, prepend=-1))
                times = np.diff(np.append(new, len(sorted_)))
                local = sorted_[new]
                rank[local[np.argsort(-times, kind="stable")]] = np.arange(len(local), dtype=np.int32)
                who = owner[a:b].astype(np.int64)
                turn = np.flatnonzero(np.diff(who, prepend=-1))
                blob = squeeze(_steps(known[local].view(np.uint64)), times, *rank[codes].reshape(3, -1), _steps(who[turn]), np.diff(np.append(turn, b - a)))
                rows.append((int(plan.buckets[int(bucket[a])]), base + serial, blob, None))
            head = pa.table({"id": pa.concat_arrays([p[4] for p in pend]), "held": pa.array(held), "n": pa.array(counts.astype(np.int64))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_table(head)
            if share == 0:  # in its own row, if the share has none of the flush's buckets
                rows = [(*rows[0][:-1], sink.getvalue().to_pybytes()), *rows[1:]] if rows else [(int(plan.buckets[np.flatnonzero(mine_of)[0]]), base + serial, squeeze(*[np.zeros(0, np.int64)] * 7), sink.getvalue().to_pybytes())]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["bucket", "flush", "tokens", "header"])

        for batch in batches:
            ids, held = batch.column("doc_id"), np.array(batch.column("held"), dtype=bool)
            numbers = ids.fill_null(0).to_numpy()
            for s in K.slices(batch.column("text"), SLICE):
                n = len(s.bounds) - 1
                t, one, two, counts = _tokens(s, starts, numbers[s.first : s.first + n])
                if pend and (have + len(t) > FLUSH_TOKENS or texts + n > 30_000):
                    yield flush()
                    serial += 1
                    pend, have, texts = [], 0, 0
                pend.append((t, one, two, counts, ids.slice(s.first, n), held[s.first : s.first + n]))
                have, texts = have + len(t), texts + n
        if pend:
            yield flush()

    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    # a checkpoint keeps its plan's partitioning, so that messages join it without another shuffle of tokens; an adaptive
    # plan has none to keep
    with settings(spark, TIDY | {"spark.sql.adaptive.enabled": "false"}):
        return map_arrow(docs, run, _PACKED).repartition(buckets, "bucket").checkpoint()


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; sorting beats hashing here."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[:1] - 1))] if len(x) else x


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and where each of codes is among them."""
    order = np.argsort(codes)
    new = np.diff(codes[order], prepend=codes[order[:1]] - 1) != 0
    place = np.empty(len(codes), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return codes[order[new]], place


class Bucket:
    """The contexts of a bucket and their training counts.

    words: sorted hashes.  Contexts, pairs (u1, w) and triples are sorted codes; a triple has the place of its context
    and of its pair, a pair that of its word before (ones).
    """

    def __init__(self, rows: pa.Table, plan: Plan, where: bool = False):
        """where: keep the triple of every token that is learned from, in the order of the rows."""
        rows = rows.sort_by("flush")
        self.flushes, self.headers = rows["flush"].to_pylist(), rows["header"].to_pylist()
        self.plan, self.rows = plan, []
        dictionaries, learned = [], []
        for blob in rows["tokens"]:
            steps, times, one, two, w, who, lengths = unsqueeze(blob.as_buffer())
            rank = np.argsort(-times, kind="stable")  # places in the dictionary by rank
            dictionaries.append(np.cumsum(steps))
            self.rows.append((*(rank[x].astype(np.int32) for x in (one, two, w)), np.cumsum(who).astype(np.uint16), lengths.astype(np.int32)))
        self.words = _distinct(np.concatenate(dictionaries)).view(np.uint64)
        for i, (one, two, w, who, lengths) in enumerate(self.rows):
            to = np.searchsorted(self.words, dictionaries[i].view(np.uint64)).astype(np.int32)
            self.rows[i] = (to[one], to[two], to[w], who, lengths)
            learned.append(np.repeat(who & 1 == 0, lengths))
        dictionaries.clear()
        self.asked = np.flatnonzero(np.bincount(np.concatenate([r[2] for r in self.rows]), minlength=len(self.words)))  # all words that follow, learned from or not
        self.hot_of = common = plan.common_at(self.words)  # of each word
        self.hot_pairs = _distinct(np.concatenate([(h[h >= 0] << 32) | r[2][h >= 0] for r in self.rows for h in (common[r[0]],)]))  # (common word, word), learned from or not
        one, two, w = (np.concatenate([r[k][m] for r, m in zip(self.rows, learned, strict=True)]).astype(np.int64) for k in range(3))
        self.learned = np.bincount(w, minlength=len(self.words)).astype(np.int64)
        self.contexts, place = _runs(one << 32 | two)
        del one, two
        place <<= 32
        place |= w
        del w
        if where:
            self.triples, self.where = _runs(place)
            self.c = np.bincount(self.where, minlength=len(self.triples)).astype(np.int64)
        else:
            place.sort()
            new = np.flatnonzero(np.diff(place, prepend=place[:1] - 1))
            self.triples, self.c = place[new], np.diff(np.append(new, len(place)))
        del place
        self.context = self.triples >> 32
        self.w = self.triples & 0xFFFFFFFF
        self.pairs, self.pair = _runs((self.contexts[self.context] >> 32) << 32 | self.w)
        self.pair_w = self.pairs & 0xFFFFFFFF
        self.ones, self.one = _runs(self.pairs >> 32)  # words before, and that of each pair
        self.hot = common[self.ones][self.one] >= 0 if len(self.pairs) else np.zeros(0, dtype=bool)
        self.seed = int(K.mix(np.array([rows["bucket"][0].as_py()], dtype=np.uint64))[0] >> U64(1))


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for 0 <= t <= c <= most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        for t in range(1, c + 2):
            grow = np.log(c - d * t) + out[c, t] if t <= c and c - d * t > 0 else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], grow)
    return out


def _uniform(seed: np.ndarray, n: int) -> np.ndarray:
    return ((K.mix(seed + U64(n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def draw_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, strength: float, seed: int) -> np.ndarray:
    """Tables for c customers given the restaurant's other tables and the parent's probability of the word."""
    rng = np.random.Generator(np.random.PCG64(seed))
    stirling = log_stirling(d)
    t = np.minimum(c, 1).astype(np.int64)
    first = np.minimum(c, EXACT)
    some = np.flatnonzero(first > 1)
    some = some[np.argsort(first[some], kind="stable")]
    edge = np.searchsorted(first[some], np.arange(EXACT + 2))
    for k in range(2, EXACT + 1):
        for lo in range(edge[k], edge[k + 1], 100_000):
            at = some[lo : min(lo + 100_000, edge[k + 1])]
            steps = np.log(strength + d * (others[at][:, None] + np.arange(k))) + np.log(parent[at])[:, None]
            logit = np.cumsum(steps, axis=1) + stirling[k, 1 : k + 1]
            p = np.cumsum(np.exp(logit - logit.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (p < (rng.random(len(at)) * p[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(c > EXACT)
    done = np.full(len(big), EXACT, dtype=np.int64)
    while len(big):
        block = np.minimum(done // 16, c[big] - done)
        new = (strength + d * (others[big] + t[big])) * parent[big]
        t[big] += rng.binomial(block, new / (new + done - d * t[big]))
        done += block
        more = done < c[big]
        big, done = big[more], done[more]
    return t


def probability(c, t, customers, tables, d: float, parent, strength: float = STRENGTH):
    """The predictive probability of a word with c customers at t tables, in a restaurant with so many in all."""
    return (c - d * t + (strength + d * tables) * parent) / (strength + customers)


class Sweep(NamedTuple):
    """Sums that a sweep left: customers and tables of the root and of the common words' restaurants."""

    root: tuple[int, int]
    customers: np.ndarray
    tables: np.ndarray


class Model(NamedTuple):
    """What all buckets know: training tokens, vocabulary, discounts from the root on, and the sums after each sweep."""

    n: int
    v: int
    d: tuple[float, float, float]
    sweeps: list[Sweep]

    def root(self, c: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
        s = self.sweeps[k]
        return probability(c, t, s.root[0], s.root[1], self.d[0], 1.0 / (self.v + 1))


_MESSAGE = "kind string, sweep int, target long, origin long, index long, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in _MESSAGE.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]


def _messages(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.table([pa.array(x, k) for x, k in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _sum_row(index: int, value: int, sweep: int) -> tuple:
    return ("sum", sweep, value, 0, index, None, None, None, None, None)


def _ask(b: Bucket, key: int, k: int, pair_tables: np.ndarray, triple_tables: np.ndarray) -> Iterator[tuple]:
    """To each bucket of words: the words of this bucket, the customers that they send to the root, the tokens learned
    from; and the pairs of common words with the customers that they send there."""
    customers = np.bincount(b.pair_w[~b.hot], weights=pair_tables[~b.hot], minlength=len(b.words)).astype(np.int64)
    sent = np.zeros(len(b.hot_pairs), dtype=np.int64)
    if b.hot.any():
        own = np.bincount(b.pair, weights=triple_tables, minlength=len(b.pairs)).astype(np.int64)[b.hot]
        code = b.hot_of[b.ones[b.one[b.hot]]] << 32 | b.pair_w[b.hot]
        sent[np.searchsorted(b.hot_pairs, code)] = own
    words = b.words[b.asked]
    to, hot_w = b.plan.word_bucket(words), b.hot_pairs & 0xFFFFFFFF
    hot_to = b.plan.word_bucket(b.words[hot_w])
    for t in np.unique(to).tolist():
        at, pairs = np.flatnonzero(to == t), np.flatnonzero(hot_to == t)
        place = np.searchsorted(b.asked[at], hot_w[pairs])
        learned = small(b.learned[b.asked[at]]) if k == 0 else None
        hot = np.stack((b.hot_pairs[pairs] >> 32, place)) if len(pairs) else np.zeros((2, 0), dtype=np.int64)
        yield ("ask", k, int(b.plan.word_buckets[t]), key, t, squeeze(_steps(words[at])), small(customers[b.asked[at]]), learned, small(hot.ravel()), small(sent[pairs]))


def _heard(b: Bucket, replies: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Root customers and tables and training tokens by word of the bucket, customers and tables by its common pairs."""
    c, t, n = (np.zeros(len(b.words), dtype=np.int64) for _ in range(3))
    hot = np.zeros((2, len(b.hot_pairs)), dtype=np.int64)
    words = b.words[b.asked]
    to, hot_to = b.plan.word_bucket(words), b.plan.word_bucket(b.words[b.hot_pairs & 0xFFFFFFFF])
    for r in replies:
        at, pairs = b.asked[to == r["index"]], np.flatnonzero(hot_to == r["index"])
        c[at], t[at] = large(r["a"]), large(r["b"])
        if r["c"] is not None:
            n[at] = large(r["c"])
        hot[0, pairs], hot[1, pairs] = large(r["d"]), large(r["e"])
    return c, t, n, hot[0], hot[1]


class Levels(NamedTuple):
    """Customers and tables of a bucket's restaurants after a sweep, and the probabilities that they give."""

    root: np.ndarray  #: by word
    pair_c: np.ndarray
    pair_t: np.ndarray
    one_c: np.ndarray
    one_t: np.ndarray
    pair: np.ndarray  #: probability by pair
    triple_t: np.ndarray
    context_t: np.ndarray


def _levels(b: Bucket, g: Model, k: int, replies: list[dict], state: dict | None) -> Levels:
    root_c, root_t, _, hot_c, hot_t = _heard(b, replies)
    root = g.root(root_c, root_t, k)
    triple_t = large(state["a"]) if state else np.minimum(b.c, 1)
    pair_c = np.bincount(b.pair, weights=triple_t, minlength=len(b.pairs)).astype(np.int64)
    pair_t = large(state["b"]) if state else np.minimum(pair_c, 1)
    if b.hot.any():
        code = b.hot_of[b.ones[b.one[b.hot]]] << 32 | b.pair_w[b.hot]
        at = np.searchsorted(b.hot_pairs, code)
        pair_c[b.hot], pair_t[b.hot] = hot_c[at], hot_t[at]
    one_c, one_t = (np.bincount(b.one, weights=x, minlength=len(b.ones)).astype(np.int64) for x in (pair_c, pair_t))
    common = b.hot_of[b.ones]
    there = common >= 0
    one_c[there], one_t[there] = g.sweeps[k].customers[common[there]], g.sweeps[k].tables[common[there]]
    pair = probability(pair_c, pair_t, one_c[b.one], one_t[b.one], g.d[1], root[b.pair_w])
    context_t = np.bincount(b.context, weights=triple_t, minlength=len(b.contexts)).astype(np.int64)
    return Levels(root, pair_c, pair_t, one_c, one_t, pair, triple_t, context_t)


def _begin(key: tuple, rows: pa.Table, plan: Plan) -> pa.Table:
    """The counts of a bucket, at one table for each word of a restaurant."""
    b = Bucket(rows, plan)
    ones = np.minimum(b.c, 1)
    pair_c = np.bincount(b.pair, weights=ones, minlength=len(b.pairs)).astype(np.int64)
    own = pair_c[~b.hot]
    stats = [int(b.c.sum()), 0, int((b.c == 1).sum()), int((b.c == 2).sum()), int((own == 1).sum()), int((own == 2).sum())]
    return _messages([*(_sum_row(i, x, 0) for i, x in enumerate(stats)), *_ask(b, key[0].as_py(), 0, np.minimum(pair_c, 1), ones)])


def _sweep(key: tuple, rows: pa.Table, side: pa.Table, plan: Plan, g: Model, k: int) -> pa.Table:
    """Sweep k over a bucket's restaurants, given what sweep k - 1 left."""
    b, told = Bucket(rows, plan), side.to_pylist()
    old = _levels(b, g, k - 1, [r for r in told if r["kind"] == "reply"], next((r for r in told if r["kind"] == "state"), None))
    triple_t = draw_tables(b.c, np.maximum(old.context_t[b.context] - old.triple_t, 0), old.pair[b.pair], g.d[2], STRENGTH, b.seed + 2 * k)
    pair_c = np.bincount(b.pair, weights=triple_t, minlength=len(b.pairs)).astype(np.int64)
    pair_t = np.where(b.hot, 0, draw_tables(np.where(b.hot, 0, pair_c), np.maximum(old.one_t[b.one] - old.pair_t, 0), old.root[b.pair_w], g.d[1], STRENGTH, b.seed + 2 * k + 1))
    me = key[0].as_py()
    return _messages([("state", k, me, me, 0, small(triple_t), small(pair_t), None, None, None), *_ask(b, me, k, pair_t, triple_t)])


def _words(key: tuple, asks: pa.Table, side: pa.Table, g: Model | None, k: int) -> pa.Table:
    """One step of a bucket of words: the root's and the common words' customers are summed, and their tables drawn."""
    rows = sorted(asks.to_pylist(), key=lambda r: r["origin"])
    if not rows:
        return _messages([])
    told = [np.cumsum(unsqueeze(r["a"])[0]) for r in rows]
    words, place = np.unique(np.concatenate(told), return_inverse=True)
    ends = np.cumsum([len(x) for x in told])
    places = np.split(place, ends[:-1])
    codes, sent = [], []
    for r, at in zip(rows, places, strict=True):
        hot = large(r["d"]).reshape(2, -1)
        codes.append(hot[0] << 32 | at[hot[1]])
        sent.append(large(r["e"]))
    pairs, where = np.unique(np.concatenate(codes), return_inverse=True)
    pair_c = np.bincount(where, weights=np.concatenate(sent), minlength=len(pairs)).astype(np.int64)
    pair_w, pair_h = pairs & 0xFFFFFFFF, pairs >> 32
    c = np.bincount(place, weights=np.concatenate([large(r["b"]) for r in rows]), minlength=len(words)).astype(np.int64)
    seed = int(K.mix(np.array([key[0].as_py() + 1], dtype=np.uint64))[0] >> U64(1))
    tokens = np.bincount(place, weights=np.concatenate([large(r["c"]) for r in rows]), minlength=len(words)).astype(np.int64) if k == 0 else None
    if k == 0:
        pair_t = np.minimum(pair_c, 1)
    else:
        old = side.to_pylist()[0]
        old_c, old_t, old_pair = large(old["a"]), large(old["b"]), large(old["c"])
        root = g.root(old_c, old_t, k - 1)
        pair_t = draw_tables(pair_c, np.maximum(g.sweeps[k - 1].tables[pair_h] - old_pair, 0), root[pair_w], g.d[1], STRENGTH, seed + 2 * k)
    c += np.bincount(pair_w, weights=pair_t, minlength=len(words)).astype(np.int64)
    if k == 0:
        t = np.minimum(c, 1)
    else:
        t = draw_tables(c, np.maximum(g.sweeps[k - 1].root[1] - old_t, 0), np.full(len(c), 1.0 / (g.v + 1)), g.d[0], STRENGTH, seed + 2 * k + 1)
    me = key[0].as_py()
    out = [("state", k, me, me, 0, small(c), small(t), small(pair_t), None, None)]
    sums = {6: c.sum(), 7: t.sum(), 8: (c == 1).sum(), 9: (c == 2).sum(), 4: (pair_c == 1).sum(), 5: (pair_c == 2).sum(), 1: (tokens > 0).sum() if k == 0 else 0}
    for h in np.unique(pair_h).tolist():
        sums[10 + 2 * h], sums[11 + 2 * h] = pair_c[pair_h == h].sum(), pair_t[pair_h == h].sum()
    out += [_sum_row(i, int(x), k) for i, x in sums.items()]
    at_pair = np.split(where, np.cumsum([len(x) for x in codes])[:-1])
    for r, at, hot in zip(rows, places, at_pair, strict=True):
        out.append(("reply", k, r["origin"], me, r["index"], small(c[at]), small(t[at]), small(tokens[at]) if k == 0 else None, small(pair_c[hot]), small(pair_t[hot])))
    return _messages(out)


def _totals(*tables: DataFrame) -> dict[int, int]:
    out: dict[int, int] = {}
    for df in tables:
        for r in df.where("kind = 'sum'").groupBy("index").agg(F.sum("target").alias("x")).collect():
            out[r["index"]] = out.get(r["index"], 0) + r["x"]
    return out


def _discount(one: int, two: int) -> float:
    return float(min(0.95, max(0.05, one / (one + 2 * two)))) if one + two else 0.5


def _left(sums: dict[int, int], common: int) -> Sweep:
    of = lambda base: np.array([sums.get(base + 2 * h, 0) for h in range(common)], dtype=np.int64)
    return Sweep((sums.get(6, 0), sums.get(7, 0)), of(10), of(11))


def _cogroup(left: DataFrame, right: DataFrame, on: str, schema: str, f, *known) -> DataFrame:
    """f(key, rows of left, rows of right, *known) for every value of on; right names it target."""
    return left.groupBy(on).cogroup(right.withColumnRenamed("target", on).groupBy(on)).applyInArrow(lambda key, a, b: f(key, a, b, *known), schema)


def _by_share(packed: list[DataFrame], side: DataFrame, schema: str, f, *known) -> DataFrame:
    """f over all buckets and the messages to them."""
    own = [_cogroup(p, side.where(F.pmod("target", F.lit(SHARES)) == share), "bucket", schema, f, *known) for share, p in enumerate(packed)]
    return functools.reduce(DataFrame.unionAll, own)


def _scores(key: tuple, rows: pa.Table, side: pa.Table, plan: Plan, g: Model) -> pa.Table:
    """(flush, header, sums): for the documents with tokens in the bucket the known ones, log10(c + 1) and log10 probabilities."""
    b, told = Bucket(rows, plan, where=True), side.to_pylist()
    learned = _heard(b, [r for r in told if r["kind"] == "reply" and r["sweep"] == 0])[2]
    samples = []
    for k in range(SWEEPS - SAMPLES + 1, SWEEPS + 1):
        replies = [r for r in told if r["kind"] == "reply" and r["sweep"] == k]
        samples.append((_levels(b, g, k, replies, next(r for r in told if r["kind"] == "state" and r["sweep"] == k)), *_heard(b, replies)[3:], g.sweeps[k]))
    context_c = np.bincount(b.context, weights=b.c, minlength=len(b.contexts)).astype(np.int64)
    base, out = np.log10(learned + 1.0), []

    def find(codes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        order, at = np.argsort(x), np.empty(len(x), dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(codes, x[order]), len(codes) - 1)  # in order, for the cache
        return at, codes[at] == x

    # what was learned from has the probability of its triple; only other tokens are looked up
    own = np.zeros(len(b.triples))
    for x, _, _, _ in samples:
        own += probability(b.c, x.triple_t, context_c[b.context], x.context_t[b.context], g.d[2], x.pair[b.pair])
    own, done = np.log10(own / SAMPLES), 0

    take = lambda x, at, there: np.where(there, x[at], 0) if len(x) else np.zeros(len(at), dtype=np.int64)
    pick = lambda common, own_, shared: np.where(common, shared, own_)

    def unseen(one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens that weren't learned from."""
        context, has_context = find(b.contexts, one << 32 | two)
        triple, has_triple = find(b.triples, context << 32 | w)
        has_triple &= has_context
        pair, has_pair = find(b.pairs, one << 32 | w)
        before, has_before = find(b.ones, one)
        hot = b.hot_of[one]
        at, common = np.maximum(hot, 0), hot >= 0
        hot_pair, has_hot = find(b.hot_pairs, at << 32 | w)
        p = np.zeros(len(w))
        for x, hot_c, hot_t, left in samples:
            pair_c, pair_t = pick(common, take(x.pair_c, pair, has_pair), take(hot_c, hot_pair, has_hot)), pick(common, take(x.pair_t, pair, has_pair), take(hot_t, hot_pair, has_hot))
            one_c, one_t = pick(common, take(x.one_c, before, has_before), take(left.customers, at, common)), pick(common, take(x.one_t, before, has_before), take(left.tables, at, common))
            lower = probability(pair_c, pair_t, one_c, one_t, g.d[1], x.root[w])
            p += probability(take(b.c, triple, has_triple), take(x.triple_t, triple, has_triple), take(context_c, context, has_context), take(x.context_t, context, has_context), g.d[2], lower)
        return np.log10(p / SAMPLES)

    for i, (one, two, w, who, lengths) in enumerate(b.rows):
        held = np.repeat(who & 1 == 1, lengths)
        who = np.repeat((who >> 1).astype(np.int64), lengths)
        logp = np.empty(len(w))
        n = len(w) - int(held.sum())
        logp[~held] = own[b.where[done : done + n]]
        done += n
        logp[held] = unseen(*(x[held].astype(np.int64) for x in (one, two, w)))
        n = int(who.max(initial=-1)) + 1
        touched = np.flatnonzero(np.bincount(who, minlength=n))
        sums = [np.bincount(who, weights=y, minlength=n)[touched] for y in ((learned[w] > 0).astype(float), base[w], logp)]
        out.append((b.flushes[i], b.headers[i], touched.astype(np.uint16).tobytes() + b"".join(y.tobytes() for y in sums)))
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["flush", "header", "sums"])


def _gather(rows: pa.Table, g: Model) -> pa.Table:
    """The results of a flush's documents, from the sums of all buckets."""
    head = next(x for x in rows["header"].to_pylist() if x is not None)
    docs = pa.ipc.open_stream(head).read_all()
    n = docs.num_rows
    known, base, logp = np.zeros(n), np.zeros(n), np.zeros(n)
    for blob in sorted(rows["sums"].to_pylist()):
        m = len(blob) // 26
        at = np.frombuffer(blob, dtype=np.uint16, count=m)
        x = np.frombuffer(blob[2 * m :], dtype=np.float64).reshape(3, m)
        known[at] += x[0]
        base[at] += x[1]
        logp[at] += x[2]
    tokens, shift = np.array(docs["n"]), np.log10(float(g.n + g.v + 1))
    return pa.table(
        {
            "doc_id": docs["id"], "held_out": pa.array(np.array(docs["held"]).astype(bool)), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(np.rint(known).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, g.n), pa.int64()), "base_score": pa.array(base - tokens * shift), "score": pa.array(logp), "perplexity": pa.array(10 ** np.minimum(-logp / tokens, 300)),
        }
    )


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    held: rows that the model doesn't learn from.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    total = source.count()
    mean, shares = _probe(source)
    tokens = int(mean * total) + 1
    buckets = max(12, -(-tokens // BUCKET_TOKENS))
    hot = {w: s for w, s in shares.items() if s * tokens > BUCKET_TOKENS / 2 or s * buckets > 1}
    common = np.sort(np.array(list(hot), dtype=np.int64).view(np.uint64))
    parts = np.array([min(buckets, max(1, round(2 * hot[int(h)] * buckets))) for h in common.view(np.int64)], dtype=np.int64)
    plan = Plan(common, parts, _keys(spark, buckets), _keys(spark, max(4, -(-tokens // (8 * BUCKET_WORDS)))))
    packed = []
    for share in range(SHARES):
        packed.append(_deal(source, plan, max(1, -(-total // BUCKET_TOKENS)), share))
        let_go(spark, settle=1.5)
    begun = (p.groupBy("bucket").applyInArrow(lambda key, rows: _begin(key, rows, plan), _MESSAGE) for p in packed)
    first = cut(functools.reduce(DataFrame.unionAll, begun))
    no_state = first.where("kind = 'state'")
    asks = lambda own: own.where("kind = 'ask'").withColumnRenamed("target", "place")
    word_steps = [cut(_cogroup(asks(first), first.where("kind = 'state'"), "place", _MESSAGE, _words, None, 0))]
    sums = _totals(first, word_steps[0])
    discounts = tuple(_discount(sums.get(i, 0), sums.get(i + 1, 0)) for i in (8, 4, 2))
    g = Model(sums.get(0, 0), sums.get(1, 0), discounts, [_left(sums, len(common))])
    own_steps, last = [first], range(SWEEPS - SAMPLES + 1, SWEEPS + 1)
    for k in range(1, SWEEPS + 1):
        side = own_steps[-1].where("kind = 'state'").unionByName(word_steps[-1].where("kind = 'reply'"))
        own_steps.append(cut(_by_share(packed, side, _MESSAGE, _sweep, plan, g, k)))
        word_steps.append(cut(_cogroup(asks(own_steps[-1]), word_steps[-1].where("kind = 'state'"), "place", _MESSAGE, _words, g, k)))
        g = g._replace(sweeps=[*g.sweeps, _left(_totals(word_steps[-1]), len(common))])
        if k - 1 not in last:
            drop_table(own_steps[k - 1], *word_steps[max(1, k - 1) : k])
    side = word_steps[0].where("kind = 'reply'")
    for k in last:
        side = side.unionByName(own_steps[k].where("kind = 'state'")).unionByName(word_steps[k].where("kind = 'reply'"))
    partial = _by_share(packed, side, "flush long, header binary, sums binary", _scores, plan, g)
    return partial.groupBy("flush").applyInArrow(lambda key, rows: _gather(rows, g), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
