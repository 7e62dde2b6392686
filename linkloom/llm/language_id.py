"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` is trained for each language over folded letters
(lower case; everything that is no letter is one blank).  The n-grams of all
languages share sorted hash arrays: an entry holds the fully interpolated log
probability and the back-off weight of every language, so a text needs one
lookup for each character and order.  The language with the lowest cross-entropy
for each character wins.

Calibration, on held-back sample texts: a temperature that turns differences of
cross-entropy into a probability, and for each language the cross-entropy beyond
which a text is rejected as being in no learned language (none, if no text of it
was held back).

Defined results: a text that is null, empty or without letters gets ``und``,
score 0 and is not accepted.  Equal cross-entropies go to the language whose
name sorts first.  With no labelled text at all every text gets ``und``.
Repeated rows are scored alike; null ids are kept.  Very long texts are scored
whole.  Columns of the results' names are replaced.  Beyond the 65,534 commonest
letters of the training texts, letters count as one unknown.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import kernels as K
from linkloom.llm.common import HashTable, attach, sums_by_text

ORDER = 4
#: Training texts of a language, in expectation; its texts of the smallest id hashes.
TEXTS_PER_LANGUAGE = 600
CHAR_BITS = 16
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.15
BLANK = 32
#: Bytes of text scored together; the working arrays are some 60 times that.
SLICE = 1 << 16

FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()),
]


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """The folded code point of every code point."""
    fold = np.full(sys.maxunicode + 1, BLANK, dtype=np.int32)
    for c in range(0x32400):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


def _letters(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, each text led by one blank and runs of blanks collapsed; where each text starts."""
    fold = _folding()
    raw = s.codes
    lead = (raw & 0xC0) != 0x80  # first bytes of characters
    at = np.concatenate(([0], np.cumsum(lead)))[s.bounds]
    points = fold[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)]
    n = len(at) - 1
    out = np.full(len(points) + n, BLANK, dtype=np.int32)
    out[np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = points
    first = at + np.arange(n + 1)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
    keep[first[:-1]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[first]


def _keys(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids that end at each position; ids are below 2**CHAR_BITS and k at most 4, so keys don't collide."""
    key = ids.astype(np.uint64)
    for j in range(1, k):
        key[j:] |= ids[:-j].astype(np.uint64) << np.uint64(CHAR_BITS * j)
    return (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


class Model:
    """The models of all languages, as sorted hash arrays by order."""

    def __init__(self, languages: list[str], alphabet: np.ndarray):
        self.languages, self.alphabet = languages, alphabet
        self.tables: list[HashTable] = []
        self.logp: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        self.floor = np.float32(-np.log(len(alphabet) + 1))  # the alphabet and one unknown character
        self.temperature = 1.0
        self.limits = np.full(len(languages), np.inf)

    def ids(self, points: np.ndarray) -> np.ndarray:
        """Dense ids of folded code points; unknown ones share id 1."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, 1).astype(np.int32)

    def cross_entropy(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character of every text and language, and the letters of each text."""
        points, first = _letters(s)
        ids = self.ids(points)
        index = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        logp = self._order(ids, index, np.flatnonzero(index > 0), ORDER)
        n = np.diff(first) - 1
        total = np.zeros((len(n), len(self.languages)))
        some = n > 0
        if some.any():
            total[some] = np.add.reduceat(logp, np.concatenate(([0], np.cumsum(n)))[:-1][some].astype(np.int64), axis=0, dtype=np.float64)
        letters = sums_by_text(points != BLANK, first)
        return -total / np.maximum(n, 1)[:, None], letters

    def _order(self, ids: np.ndarray, index: np.ndarray, at: np.ndarray, k: int, keys: dict | None = None) -> np.ndarray:
        """Log probabilities at the positions, from n-grams of order k or less."""
        keys = {} if keys is None else keys
        if k == 0:
            return np.full((len(at), len(self.languages)), self.floor, dtype=np.float32)
        if k not in keys:
            keys[k] = _keys(ids, k)
        found = self.tables[k - 1].find(keys[k][at])
        found[index[at] < k - 1] = -1
        out = self.logp[k - 1][found]
        rest = np.flatnonzero(found < 0)
        if len(rest):
            where = at[rest]
            lower = self._order(ids, index, where, k - 1, keys)
            if k > 1:
                if k - 1 not in keys:
                    keys[k - 1] = _keys(ids, k - 1)
                context = self.tables[k - 2].find(keys[k - 1][where - 1])
                context[index[where] < k - 1] = -1
                lower = lower + np.where((context >= 0)[:, None], self.backoff[k - 2][context], np.float32(0))
            else:
                lower = lower + self.root
            out[rest] = lower
        return out

    def decide(self, entropy: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: none), score, cross-entropy and acceptance of each text."""
        if not len(self.languages):
            n = len(letters)
            return np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.zeros(n, dtype=bool)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = 1.0 / np.exp(-(entropy - low[:, None]) * self.temperature).sum(axis=1)
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, np.nan, low), ~none & (low <= self.limits[best])


def train(texts: pa.Array, langs: list[str]) -> Model:
    """Models of the languages from labelled texts; every fourth text is held back for calibration."""
    languages = sorted(set(langs))
    label = np.array([languages.index(x) for x in langs], dtype=np.int64)
    held = np.arange(len(langs)) % 4 == 3
    pieces: list[list[np.ndarray]] = [[] for _ in languages]
    for s in K.slices(texts, SLICE):
        points, first = _letters(s)
        for i in range(len(first) - 1):
            t = s.first + i
            if not held[t]:
                pieces[label[t]].append(points[first[i] : first[i + 1]])
    known = [np.concatenate(p) if p else np.zeros(0, dtype=np.int32) for p in pieces]
    seen, times = np.unique(np.concatenate(known) if known else np.zeros(0, np.int32), return_counts=True)
    if len(seen) > (1 << CHAR_BITS) - 2:
        seen = np.sort(seen[np.argsort(-times, kind="stable")[: (1 << CHAR_BITS) - 2]])
    model = Model(languages if len(seen) else [], seen if len(seen) else np.array([BLANK], dtype=np.int32))
    if not len(seen):
        return model
    counts = []  # by language and order: hash -> (count, context hash, suffix hash)
    for own in pieces:
        grams = {}
        for k in range(1, ORDER + 1):
            key, ctx, suf = [], [], []
            for p in own:
                ids = model.ids(p)
                if len(ids) > k or (len(ids) >= k and k > 1):
                    full = _keys(ids, k)
                    lo = max(k - 1, 1)
                    key.append(full[lo:])
                    if k > 1:
                        part = _keys(ids, k - 1)
                        ctx.append(part[lo - 1 : -1])
                        suf.append(part[lo:])
            if key:
                u, i, c = np.unique(np.concatenate(key), return_index=True, return_counts=True)
                grams[k] = (u, c, np.concatenate(ctx)[i] if k > 1 else None, np.concatenate(suf)[i] if k > 1 else None)
            else:
                e = np.zeros(0, np.uint64)
                grams[k] = (e, np.zeros(0, np.int64), e, e)
        counts.append(grams)
    n_lang, uniform = len(languages), 1.0 / (len(model.alphabet) + 1)
    model.tables = [HashTable(np.unique(np.concatenate([g[k][0] for g in counts]))) for k in range(1, ORDER + 1)]
    model.root = np.zeros(n_lang, dtype=np.float32)
    model.logp = [np.zeros((len(t.hashes), n_lang), dtype=np.float32) for t in model.tables]
    model.backoff = [np.zeros((len(t.hashes), n_lang), dtype=np.float32) for t in model.tables]
    relation = []  # for each order, context and suffix of every entry of the shared table
    for k in range(1, ORDER + 1):
        c, f = (np.zeros(len(model.tables[k - 1].hashes), dtype=np.int64) for _ in range(2))
        if k > 1:
            for g in counts:
                at = model.tables[k - 1].find(g[k][0])
                c[at], f[at] = model.tables[k - 2].find(g[k][2]), model.tables[k - 2].find(g[k][3])
        relation.append((c, f))
    for lang, grams in enumerate(counts):
        lower = np.full(len(model.tables[0].hashes), uniform)
        for k in range(1, ORDER + 1):
            u, c, _, _ = grams[k]
            size = len(model.tables[k - 1].hashes)
            n = np.zeros(size)
            if k == ORDER:
                n[model.tables[k - 1].find(u)] = c
            else:  # how many different characters stand before it
                suffix = model.tables[k - 1].find(grams[k + 1][3])
                n += np.bincount(suffix[suffix >= 0], minlength=size)[:size]
            one, two = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5
            ctx, suf = relation[k - 1]
            contexts = len(model.tables[k - 2].hashes) if k > 1 else 1
            total = np.bincount(ctx[ctx >= 0], weights=n[ctx >= 0], minlength=contexts)
            kinds = np.bincount(ctx[ctx >= 0], weights=(n > 0)[ctx >= 0], minlength=contexts)
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            below = lower[suf] if k > 1 else np.full(size, uniform)
            below = np.where(suf >= 0, below, uniform)
            p = np.where(total[ctx] > 0, np.maximum(n - d, 0) / np.maximum(total[ctx], 1), 0) + weight[ctx] * below
            model.logp[k - 1][:, lang] = np.log(np.maximum(p, 1e-12))
            if k > 1:
                model.backoff[k - 2][:, lang] = np.log(np.maximum(weight, 1e-12))
            else:
                model.root[lang] = np.log(max(weight[0], 1e-12))
            lower = p
    _calibrate(model, texts, label, held)
    return model


def _calibrate(model: Model, texts: pa.Array, label: np.ndarray, held: np.ndarray) -> None:
    """Temperature of least log loss, and limits of cross-entropy, on the held-back texts."""
    some = held if held.any() else np.ones(len(held), dtype=bool)
    entropy, letters = np.zeros((len(label), len(model.languages))), np.zeros(len(label))
    for s in K.slices(texts, SLICE):
        e, n = model.cross_entropy(s)
        entropy[s.first : s.first + len(n)], letters[s.first : s.first + len(n)] = e, n
    use = some & (letters > 0)
    if not use.any():
        return
    e, y = entropy[use], label[use]
    best, loss = 1.0, np.inf
    for t in 2.0 ** np.arange(-2, 8):
        z = -(e - e.min(axis=1, keepdims=True)) * t
        nll = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean() + 0.001 * t / 128
        if nll < loss:
            best, loss = t, nll
    model.temperature = best
    for lang in range(len(model.languages)):
        own = entropy[use & (label == lang), lang]
        if len(own):
            model.limits[lang] = np.quantile(own, REJECT_QUANTILE) * REJECT_MARGIN


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Trains on a bounded sample: of each language the texts whose id hash is below a share that gives texts_per_language in expectation."""
    known = labelled.where(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return Model([], np.array([BLANK], dtype=np.int32))
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, texts_per_language / n))))
    hashed = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(hashed < F.element_at(share, F.col(lang))).select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).alias("l")).toArrow()
    order = np.lexsort((np.array(rows["l"].to_pylist(), dtype=object).astype(str), np.array([str(x) for x in rows["k"].to_pylist()])))
    rows = rows.take(pa.array(order))
    return train(rows["t"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["l"].to_pylist())


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and accepted."""

    def make():
        def columns(texts: pa.Array) -> list[pa.Array]:
            parts = []
            for s in K.slices(texts, SLICE):
                entropy, letters = model.cross_entropy(s) if model.languages else (None, np.zeros(len(s.bounds) - 1))
                parts.append(model.decide(entropy, letters))
            best, score, low, accepted = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, bool))
            names = np.array([*model.languages, "und"], dtype=object)
            return [pa.array(names[best], pa.string()), pa.array(score), pa.array(low, from_pandas=True), pa.array(accepted)]

        return columns

    return attach(docs, make, FIELDS, keep, text)
