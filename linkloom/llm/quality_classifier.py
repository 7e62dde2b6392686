"""Document quality by logistic regression on hashed word n-grams.

Two views of the word sequence are hashed into one weight vector: the folded
words themselves (1- and 2-grams) and the words' shapes (1- to 3-grams: which
kinds of characters a word has, the punctuation that ends it, whether it repeats
one of the two words before).  A document's value for a feature is its count
divided by the number of words, so a score is one sparse dot product and long
texts weigh as much as short ones.

Weights come from follow-the-regularised-leader updates (per-coordinate rates,
L1 and L2) over a bounded sample of labelled documents, classes in equal parts;
the intercept then corrects for the share of the classes among all labels.

Defined results: null and empty texts, and texts without words, score by the
intercept alone.  With labels of one class only, or none, every document scores
the share of label 1 (0.5 without labels).  A document labelled more than once
counts once for each label.  Null labels are left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import kernels as K
from linkloom.llm.common import attach, bounded_sample, sigmoid, sums_by_text

DIMENSIONS = 1 << 20
#: Labelled documents of each class that the training may use, those of the smallest id hashes.
LABELLED_PER_CLASS = 2000
EPOCHS, ALPHA, BETA, L1, L2, GAIN = 3, 0.5, 1.0, 1e-4, 1e-3, 8.0
SLICE = 1 << 17
U64 = np.uint64

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

_KIND = np.full(256, 4, dtype=np.int64)  # 0 upper, 1 lower, 2 digit, 3 other ASCII, 4 beyond ASCII
_KIND[:128] = 3
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2


def word_shapes(codes: np.ndarray, w: K.Words, h: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _KIND[codes]
    shape = np.zeros(len(w.starts), dtype=np.uint64)
    for k in range(5):
        run = np.concatenate(([0], np.cumsum(kind == k)))
        n = run[w.ends] - run[w.starts]
        shape = shape * U64(3) + np.minimum(n, 2).astype(np.uint64)
    last = codes[w.ends - 1].astype(np.uint64)
    before = codes[np.maximum(w.ends - 2, w.starts)].astype(np.uint64)
    other = kind[w.ends - 1] == 3
    shape = shape * U64(256) + np.where(other, last, 0).astype(np.uint64)
    shape = shape * U64(256) + np.where(other & (kind[np.maximum(w.ends - 2, w.starts)] == 3), before, 0).astype(np.uint64)
    again = np.zeros(len(h), dtype=np.uint64)
    again[1:] += h[1:] == h[:-1]
    again[2:] += U64(2) * (h[2:] == h[:-2])
    return K.mix(shape * U64(4) + again + U64(0x51ED))


def features(s: K.Slice, dimensions: int = DIMENSIONS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram kind the hashed feature of every word position, and the words of each text.

    An n-gram belongs to its first word; the few that run over the end of a text read into the next text's
    first words within the slice and are masked with feature 0, which no weight is kept for.
    """
    w = K.words(s.codes, s.bounds)
    h = K.span_hashes(K.LOWER[s.codes], w.starts, w.ends)
    shape = word_shapes(s.codes, w, h)
    out = []
    for seed, base, n in ((1, h, 1), (2, h, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
        g = K.ngram_hashes(base, n)
        f = np.zeros(len(h), dtype=np.int32)
        m = len(g)
        if m:
            f[:m] = 1 + ((g * U64(2 * seed + 1)) >> U64(40)) % U64(dimensions - 1)
            f[:m][w.text[:m] != w.text[n - 1 : n - 1 + m]] = 0
        out.append(f)
    return out, w.counts


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over documents given as (features, values); prior: the share of label 1 to correct to."""
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)  # the last one is the intercept

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            f, x = rows[r]
            i, v = np.append(f, dimensions), np.append(x, 1.0)
            w = weight(i)
            g = (sigmoid(w @ v) - labels[r]) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(dimensions + 1))
    share = labels.mean()
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(w[:-1].astype(np.float32), float(w[-1] + shift))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, per_class: int) -> tuple[pa.Table, dict[int, int]]:
    """Texts and labels (columns t, y) of at most per_class rows of each class, and the counts of the classes.

    The sample of labels is bounded by its limits, so it is broadcast to the documents, which are scanned once.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__k"), F.col(label).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    few = bounded_sample(known.where("y = 0"), "__k", per_class).unionAll(bounded_sample(known.where("y = 1"), "__k", per_class))
    rows = docs.select(F.col(doc_id).alias("__d"), F.col(text).cast("string").alias("t")).join(F.broadcast(few), F.col("__d") == F.col("__k")).select("__d", "t", "y").toArrow()
    order = np.lexsort((np.array(rows["y"]), np.array([str(x) for x in rows["__d"].to_pylist()])))
    rows = rows.take(pa.array(order)).combine_chunks()
    return rows, counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = LABELLED_PER_CLASS) -> Model:
    rows, counts = labelled_sample(docs, labels, label, doc_id, text, per_class)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    y = np.array(rows["y"], dtype=np.float64)
    if not 0 < prior < 1 or len(set(y)) < 2:
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMENSIONS, np.float32), float(np.log(prior / (1 - prior))))
    examples = []
    for s in K.slices(rows["t"], SLICE):
        kinds, counts_ = features(s)
        ends = np.cumsum(counts_)
        for e, c in zip(ends, counts_, strict=True):
            f, n = np.unique(np.concatenate([k[e - c : e] for k in kinds]), return_counts=True)
            examples.append((f[f > 0], GAIN * n[f > 0] / max(c, 1)))
    return train(examples, y, prior)


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted."""

    def make():
        def columns(texts: pa.Array) -> list[pa.Array]:
            parts = [np.zeros(0)]
            for s in K.slices(texts, SLICE):
                kinds, counts = features(s)
                value = model.weights[kinds[0]]
                for f in kinds[1:]:
                    value = value + model.weights[f]
                total = sums_by_text(value, np.concatenate(([0], np.cumsum(counts))))
                parts.append(sigmoid(model.intercept + GAIN * total / np.maximum(counts, 1)))
            score = np.concatenate(parts)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return columns

    return attach(docs, make, FIELDS, keep, text)
