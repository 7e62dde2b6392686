"""Toxicity by gradient-boosted trees over dense features.

Features of a text: densities of three lexicons (a short fixed list; words and
word beginnings learned from the labelled sample by their log odds), the share
of lexicon words that stand near a second-person pronoun, rates of capitals,
punctuation, exclamation marks, digits and obfuscated words (letters mixed with
digits or signs), mean word length and log length.  Trees are grown on
histograms of a bounded labelled sample; scores are calibrated by isotonic
regression on a held-back third, weighted to the classes' true shares.

Defined results: null and empty texts have all features 0 and are scored like
any other.  With labels of one class only every text scores that class's share
(0 without labels).  Ties in a feature fall in one histogram bin; repeated rows
score alike.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkloom.llm import kernels as K
from linkloom.llm.common import HashTable, attach, sigmoid, sums_by_text
from linkloom.llm.quality_classifier import labelled_sample

#: Labelled documents of each class that training may use, those of the smallest id hashes.
LABELLED_PER_CLASS = 3000
TREES, DEPTH, RATE, BINS, LEAF_L2, LEAST_IN_LEAF = 80, 3, 0.15, 32, 1.0, 5
PREFIXES = (4, 5, 6)  #: bytes of a word's beginning
NEAR = 4  #: words around a pronoun
SLICE = 1 << 17
U64 = np.uint64

# A few insults, and second-person pronouns of the languages at hand.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb imbecile idiota imbécil estúpido basura idiot dumm trottel abschaum crétin imbécile ordure stupide".split()
PRONOUNS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton tes usted ustedes tú ti vosotros".split()

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

_STRIP = np.zeros(256, dtype=bool)
_STRIP[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
_ALNUM = np.zeros(256, dtype=np.int8)  # 1 letter (or beyond ASCII), 2 digit, 3 sign
_ALNUM[33:128] = 3
_ALNUM[65:91] = _ALNUM[97:123] = 1
_ALNUM[128:] = 1
_ALNUM[48:58] = 2


class Stems(NamedTuple):
    h: np.ndarray  #: hash of each word without signs around it
    beginnings: list[np.ndarray]  #: hashes of its first bytes, 0 where it is shorter
    w: K.Words
    starts: np.ndarray
    ends: np.ndarray


def stems(s: K.Slice) -> Stems:
    """Lower-cased words, stripped of ASCII signs at either end."""
    low = K.LOWER[s.codes]
    w = K.words(low, s.bounds)
    body = ~_STRIP[low] & ~K.SEPARATOR[low]
    pos = np.arange(len(low))
    nxt = np.minimum.accumulate(np.where(body, pos, len(low))[::-1])[::-1] if len(low) else pos
    prv = np.maximum.accumulate(np.where(body, pos, -1)) if len(low) else pos
    starts = np.minimum(nxt[w.starts], w.ends)
    ends = np.maximum(prv[w.ends - 1] + 1, starts)
    n = len(low)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(K._BYTE[low] * K._geometric(K._BASE, n), out=prefix[1:])
    inverse = K._geometric(K._BASE_INV, n + 1)[starts]

    def hashed(e: np.ndarray) -> np.ndarray:
        return K.mix((prefix[e] - prefix[starts]) * inverse + (e - starts).astype(np.uint64))

    beginnings = [np.where(ends - starts >= k, hashed(np.minimum(starts + k, ends)), U64(0)) for k in PREFIXES]
    return Stems(hashed(ends), beginnings, w, starts, ends)


class Lexicons(NamedTuple):
    insults: HashTable
    pronouns: HashTable
    learned: HashTable
    beginnings: list[HashTable]


N_FEATURES = 13


def dense(s: K.Slice, lex: Lexicons) -> np.ndarray:
    """Features of each text of a slice."""
    st = stems(s)
    first = np.concatenate(([0], np.cumsum(st.w.counts)))
    n = np.maximum(st.w.counts, 1)
    listed = lex.insults.find(st.h) >= 0
    learned = lex.learned.find(st.h) >= 0
    starts = np.zeros(len(st.h), dtype=bool)
    for table, h in zip(lex.beginnings, st.beginnings, strict=True):
        starts |= table.find(h) >= 0
    hit = listed | learned | starts
    you = lex.pronouns.find(st.h) >= 0
    run = np.concatenate(([0], np.cumsum(you)))
    at = np.arange(len(you))
    lo, hi = np.maximum(at - NEAR, first[st.w.text]), np.minimum(at + NEAR + 1, first[st.w.text + 1])
    near = hit & (run[hi] > run[lo])
    kind = _ALNUM[s.codes]
    runs = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3)]
    letters, digits, signs = (r[st.ends] - r[st.starts] for r in runs)
    odd = (letters > 0) & ((digits > 0) | (signs > 0)) & (st.ends - st.starts <= 16)
    chars = np.maximum(np.diff(s.bounds), 1)
    rate = lambda mask: sums_by_text(mask, s.bounds) / chars
    by_word = lambda mask: sums_by_text(mask, first)
    hits = by_word(hit)
    upper = (s.codes >= 65) & (s.codes < 91)
    return np.stack(
        [
            by_word(listed) / n, by_word(learned) / n, by_word(starts) / n, np.log1p(hits), hits / n, by_word(near) / n, np.log1p(by_word(near)),
            rate(upper), rate(kind == 3), rate(s.codes == 33), rate(kind == 2), by_word(odd) / n, np.log1p(st.w.counts),
        ],
        axis=1,
    )


def _telling(keys: list[np.ndarray], y: np.ndarray) -> HashTable:
    """Keys that stand in far more toxic than clean texts, by smoothed log odds over texts."""
    text = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    u, inv = np.unique(flat, return_inverse=True)
    toxic = np.bincount(inv, weights=y[text], minlength=len(u))
    clean = np.bincount(inv, weights=1 - y[text], minlength=len(u))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    return HashTable(u[(toxic >= 3) & (odds > 3.0) & (u != 0)])


def lexicons(texts: pa.Array, y: np.ndarray) -> Lexicons:
    words_, begin = [], [[] for _ in PREFIXES]
    for s in K.slices(texts, SLICE):
        st = stems(s)
        first = np.concatenate(([0], np.cumsum(st.w.counts)))
        for i in range(len(st.w.counts)):
            words_.append(np.unique(st.h[first[i] : first[i + 1]]))
            for b, h in zip(begin, st.beginnings, strict=True):
                b.append(np.unique(h[first[i] : first[i + 1]]))
    hashes = lambda ws: HashTable(np.array([K.hash_bytes(x.encode()) for x in dict.fromkeys(ws)], dtype=np.uint64))
    return Lexicons(hashes(INSULTS), hashes(PRONOUNS), _telling(words_, y), [_telling(b, y) for b in begin])


class Model(NamedTuple):
    lexicons: Lexicons
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  #: feature, threshold (inner nodes, by level), leaf values
    base: float
    steps: np.ndarray  #: isotonic calibration: upper margins
    levels: np.ndarray  #: and probabilities

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if len(self.steps) < 2:
            return np.full(len(x), self.levels[0] if len(self.levels) else 0.0)
        return np.interp(m, self.steps, self.levels)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list, float]:
    """Trees of logistic loss, grown level by level on quantile histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    f = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = sigmoid(f)
        g, h = p - y, p * (1 - p)
        feature = np.zeros(2**DEPTH - 1, dtype=np.int64)
        threshold = np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) < 2 * LEAST_IN_LEAF:
                    continue
                gt, ht = g[at].sum(), h[at].sum()
                best = 1e-6
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, j], weights=g[at], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, j], weights=h[at], minlength=len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[at, j], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + LEAF_L2) + (gt - gl) ** 2 / (ht - hl + LEAF_L2) - gt**2 / (ht + LEAF_L2)
                    gain[(nl < LEAST_IN_LEAF) | (len(at) - nl < LEAST_IN_LEAF)] = -1
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, feature[k], threshold[k] = gain[b], j, c[b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_at = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf_at, weights=g, minlength=2**DEPTH), np.bincount(leaf_at, weights=h, minlength=2**DEPTH)
        leaf = -RATE * gs / (hs + LEAF_L2)
        f += leaf[leaf_at]
        trees.append((feature, threshold, leaf))
    return trees, base


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins, and the non-decreasing probabilities there."""
    u, inv = np.unique(margin, return_inverse=True)
    w, v = np.bincount(inv, weights=weight), np.bincount(inv, weights=weight * y)
    blocks: list[list[float]] = []
    for m, a, b in zip(u, w, v, strict=True):
        blocks.append([m, m, a, b])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    steps = np.array([x for b in blocks for x in (b[0], b[1])])
    levels = np.array([b[3] / b[2] for b in blocks for _ in range(2)])
    return steps, levels


def train(texts: pa.Array, y: np.ndarray, prior: float) -> Model:
    """texts are ordered by id, so every third row serves calibration alone."""
    held = np.arange(len(y)) % 3 == 2
    lex = lexicons(texts.filter(pa.array(~held)), y[~held])
    x = np.concatenate([dense(s, lex) for s in K.slices(texts, SLICE)])
    trees, base = boost(x[~held], y[~held])
    model = Model(lex, trees, base, np.zeros(0), np.zeros(0))
    share = y[held].mean()
    weight = np.where(y[held] == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    steps, levels = isotonic(model.margin(x[held]), y[held], weight)
    return model._replace(steps=steps, levels=levels)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = LABELLED_PER_CLASS) -> Model:
    rows, counts = labelled_sample(docs, labels, label, doc_id, text, per_class)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    y = np.array(rows["y"], dtype=np.float64)
    if len(set(y)) < 2 or min(np.bincount(y.astype(int))) < 3:
        return Model(lexicons(pa.array([], pa.string()), np.zeros(0)), [], 0.0, np.zeros(0), np.array([prior]))
    return train(rows["t"].combine_chunks() if isinstance(rows["t"], pa.ChunkedArray) else rows["t"], y, prior)


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted."""

    def make():
        def columns(texts: pa.Array) -> list[pa.Array]:
            parts = [np.zeros(0)]
            for s in K.slices(texts, SLICE):
                parts.append(model.score(dense(s, model.lexicons)))
            score = np.concatenate(parts)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return columns

    return attach(docs, make, FIELDS, keep, text)
