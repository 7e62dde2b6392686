"""Importance resampling of documents towards a target by hashed n-grams, on an integer word dictionary.

Every task encodes documents in blocks of about ``BLOCK`` bytes of text: a block has a
dictionary of its distinct words and of its distinct runs of words, as tuples of word
numbers, and a document is the numbers of its runs, as steps from one to the next, with
their counts.  So only a
block's distinct words and tuples are shuffled, never its tokens.  The corpus dictionary
maps each distinct word to an id; each distinct tuple of ids is made bytes again and
hashed once; counts are summed by bucket, and the buckets' gains are joined back to
the blocks' tuples.  A run of one word is its word, and needs no second dictionary.

A block of documents and its gains meet in one group, which is bounded by the block.
Buckets are as many as the parameter says.  Scores are ranked over ranges.

Defined results: a null text has no features and the weight 0, an empty one too; a null
id draws as an empty one does and ranks after its ties; repeated rows are drawn each;
without a target (or documents) all gains follow from zero counts; other columns of
docs are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import Batches, cut, map_arrow
from linkloom.plans.loops import ranked

#: Bytes of text that share a dictionary; a longer text is a block of its own.
BLOCK = 1 << 23

#: Bytes outside of words: all of ASCII but digits and (lowered) letters.
GAP = np.zeros(256, dtype=bool)
GAP[:128] = True
GAP[[*range(48, 58), *range(97, 123)]] = False

_ENCODED = "block long, doc_id string, n_words long, ids array<int>, counts array<int>, words array<string>, tuples array<array<int>>, totals array<long>"


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _strings(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The spans of codes as strings."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(codes[at])).cast(pa.string())


def encode_block(block: int, ids: pa.Array, codes: np.ndarray, bounds: np.ndarray, least: int, most: int) -> pa.RecordBatch:
    """A row for each text; the block's dictionaries are in the first."""
    codes = K.LOWER[codes]
    words = K.words(codes, bounds, GAP)
    h = K.span_hashes(codes, words.starts, words.ends) if len(words.starts) else np.zeros(0, dtype=np.uint64)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    # runs of each length: their hash tells them apart, their first place gives their words
    runs, owner, at, length = [], [], [], []
    for n in range(least, most + 1):
        m = max(0, len(word) - n + 1)
        whole = np.flatnonzero(words.text[:m] == words.text[n - 1 : n - 1 + m])
        runs.append(h[whole] if n == 1 else K.ngram_hashes(h, n)[whole] ^ np.uint64(n))
        owner.append(words.text[whole])
        at.append(whole)
        length.append(np.full(len(whole), n))
    owner, at, length = (np.concatenate(x).astype(np.int64) for x in (owner, at, length))
    _, example, run = np.unique(np.concatenate(runs), return_index=True, return_inverse=True)
    kinds = max(1, len(example))
    pairs, counts = np.unique(owner * kinds + run, return_counts=True)
    n_texts = len(bounds) - 1
    cuts = np.searchsorted(pairs // kinds, np.arange(n_texts + 1))
    steps = np.diff(pairs, prepend=0)  # a text's numbers rise: their steps take less room
    opens = np.unique(cuts[:-1][np.diff(cuts) > 0])
    steps[opens] = pairs[opens] % kinds
    if most > 1:
        n = length[example]
        ends = np.cumsum(n)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[example] - (ends - n), n)
        tuples = _lists(word[places], np.concatenate(([0], ends)), pa.int32())
    else:  # by their hashes the runs stand in the order of the words
        tuples = pa.nulls(0, pa.list_(pa.int32()))
    once = np.concatenate(([0], np.full(n_texts, 1)))

    def whole_block(values: pa.Array) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(once * len(values), pa.int32()), values)
        return pa.concat_arrays([lists.slice(0, 1), pa.nulls(n_texts - 1, lists.type)])

    totals = pa.array(np.bincount(run, minlength=len(example)), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n_texts, block), pa.int64()), ids, pa.array(words.counts, pa.int64()), _lists(steps, cuts, pa.int32()), _lists(counts, cuts, pa.int32()),
            whole_block(_strings(codes, words.starts[first], (words.ends - words.starts)[first])), whole_block(tuples), whole_block(totals),
        ],
        names=["block", "doc_id", "n_words", "ids", "counts", "words", "tuples", "totals"],
    )


def encode(docs: DataFrame, least: int, most: int, doc_id: str | None, text: str) -> DataFrame:
    """Blocks of encoded texts; written."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in K.slices(batch.column("text"), BLOCK):
                ids = batch.column("doc_id").slice(part.first, len(part.bounds) - 1)
                yield encode_block(block, ids, part.codes, part.bounds, least, most)
                block += 1

    name = F.col(doc_id).cast("string") if doc_id else F.lit(None).cast("string")
    return cut(map_arrow(docs.select(name.alias("doc_id"), F.col(text).cast("string").alias("text")), run, _ENCODED))


def _per_word(encoded: DataFrame) -> DataFrame:
    """(block, word, at, total): the distinct words of each block with their number and, of runs of one word, their count."""
    return encoded.where("words IS NOT NULL").select("block", F.posexplode(F.arrays_zip("words", "totals")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.totals").alias("total"))


def _per_tuple(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(block, at, key, total): the distinct runs of each block as tuples of the words' ids."""
    words = encoded.where("words IS NOT NULL").select("block", F.posexplode("words").alias("place", "word"))
    ids = words.join(dictionary, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("of"))
    block = encoded.where("words IS NOT NULL").select("block", "tuples", "totals").join(ids, "block")
    keys = F.transform("tuples", lambda t: F.transform(t, lambda w: F.get("of", w)["id"]))
    return block.select("block", F.posexplode(F.arrays_zip(keys.alias("key"), F.col("totals").alias("total"))).alias("at", "t")).select("block", "at", F.col("t.key").alias("key"), F.col("t.total").alias("total"))


def _bucket(run: Column, buckets: int) -> Column:
    return (F.crc32(run) % buckets).cast("int")


def _distinct_words(frames: list[DataFrame]) -> DataFrame:
    """(word, id): the dictionary; written, so that an id stays with its word."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return cut(both.distinct().withColumn("id", F.monotonically_increasing_id()))


def _spelled(keys: DataFrame, dictionary: DataFrame, buckets: int) -> DataFrame:
    """keys with the bucket of each distinct tuple, from its words joined by blanks."""
    one = keys.select("key").distinct().select("key", F.posexplode("key").alias("place", "id"))
    spelled = one.join(dictionary, "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts"))
    return spelled.select("key", _bucket(F.array_join(F.col("parts.word"), " "), buckets).alias("bucket"))


def gains(counts: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from the counts (bucket, total) of the documents' and of the target's features."""
    spark = counts.sparkSession
    s = counts.groupBy("bucket").agg(F.sum("total").cast("double").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("total").cast("double").alias("t"))
    known = cut(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0.0, ["s", "t"]))
    total = known.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1) * (F.col("all_t") + float(buckets)))
    return known.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain"))


def _weigh(key: tuple, docs: pa.Table, gained: pa.Table) -> pa.Table:
    """The weights of a block's documents."""
    at, gain = (gained[c].to_numpy() for c in ("at", "gain"))
    by_run = np.zeros(int(at.max()) + 1 if len(at) else 0, dtype=np.int64)
    by_run[at] = gain
    ids, counts = (docs[c].combine_chunks() for c in ("ids", "counts"))
    first = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    each = counts.flatten().to_numpy().astype(np.int64)
    run = np.concatenate(([0], np.cumsum(ids.flatten().to_numpy().astype(np.int64))))
    run = run[1:] - np.repeat(run[first[:-1]], np.diff(first))
    sums = np.concatenate(([0], np.cumsum(by_run[run] * each)))
    n = np.concatenate(([0], np.cumsum(each)))
    return pa.table({"doc_id": docs["doc_id"], "n_words": docs["n_words"], "n_features": pa.array(n[first[1:]] - n[first[:-1]]), "weight": pa.array(sums[first[1:]] - sums[first[:-1]])})


def weigh(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id (as text), n_words, n_features and weight of each document; written."""
    if not 1 <= least <= most:
        raise ValueError("runs have one word at least")
    own, other = encode(docs, least, most, doc_id, text), encode(target, least, most, None, target_text)
    if most == 1:  # a tuple of one id is spelled by its word: the dictionary's rows are the features
        words = _per_word(own)
        dictionary = cut(words.groupBy("word").agg(F.sum("total").alias("total")).select("word", F.monotonically_increasing_id().alias("id"), "total", _bucket(F.col("word"), buckets).alias("bucket")))
        gain = gains(dictionary, _per_word(other).select(_bucket(F.col("word"), buckets).alias("bucket"), "total"), buckets)
        back = words.join(dictionary.join(gain, "bucket").select("word", "gain"), "word").select(F.col("block").alias("of"), "at", "gain")
    else:
        only = lambda e: e.where("words IS NOT NULL").select(F.explode("words").alias("word"))
        dictionary = _distinct_words([only(own), only(other)])
        runs, wanted = cut(_per_tuple(own, dictionary)), cut(_per_tuple(other, dictionary))
        buckets_of = cut(_spelled(runs.select("key").unionByName(wanted.select("key")), dictionary, buckets))
        counted = lambda r: r.groupBy("key").agg(F.sum("total").alias("total")).join(buckets_of, "key")
        gain = gains(counted(runs), counted(wanted), buckets)
        back = runs.join(buckets_of, "key").join(gain, "bucket").select(F.col("block").alias("of"), "at", "gain")
    back = cut(back)  # the words' shuffle is let go of before the texts are dealt
    texts = own.select("block", "doc_id", "n_words", "ids", "counts")
    return cut(texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_weigh, "doc_id string, n_words long, n_features long, weight long"))


def resample(
    docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1, of the drawn; else null) of each document.

    Of the documents of least_words words or more, percent of a hundred are drawn without replacement, by the largest
    weights after Gumbel noise that the seed and the id give.
    """
    weighed = weigh(docs, target, least, most, buckets, doc_id, text, target_text)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    kind = docs.schema[doc_id].dataType
    scored = weighed.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("__able"))
    drawn = weighed.where(F.col("n_words") >= least_words).count() * percent // 100
    placed = ranked(cut(scored), "__place", F.desc("__able"), F.desc("score"), F.col("doc_id").asc_nulls_last())
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("__able") & (F.col("__place") < drawn), F.col("__place") + 1).alias("rank"))
