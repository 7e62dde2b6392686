"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow string arrays.  Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D, which is exact on UTF-8 because those bytes never
occur inside a multi-byte character.  A word's hash is a polynomial over a
random byte table modulo 2**64, read off one prefix sum, then mixed; all words
of a slice are hashed in a handful of numpy passes without Python objects.

Null texts count as empty.  Slices hold about ``SLICE`` bytes so that the
working arrays stay in cache; one longer text forms a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U64 = np.uint64

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them; those of a slice are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(SLICE + 64, n)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size == SLICE + 64:
            _powers[base] = have
    return have[:n]


def powers(inverse: bool, n: int) -> np.ndarray:
    """Powers of the hash base, or of its inverse modulo 2**64."""
    return _geometric(_BASE_INV if inverse else _BASE, n)


def release() -> None:
    """Gives freed memory back to the system, so that idle workers don't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], equal for equal contents; codes are bytes.  Starts rise.

    Long codes are taken in stretches of about a slice, so working memory doesn't follow a text's length.
    """
    if len(codes) <= SLICE + 64:
        return _span_hashes(codes, starts, ends)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = _span_hashes(codes[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def _span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(codes)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    terms = _BYTE[codes]
    terms *= _geometric(_BASE, n)
    np.cumsum(terms, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _geometric(_BASE_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def hash_bytes(word: bytes) -> int:
    """The hash span_hashes gives a word."""
    codes = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(codes, np.array([0]), np.array([len(codes)]))[0])


class Slice(NamedTuple):
    first: int  #: index in the array of the first text
    codes: np.ndarray  #: bytes of the texts, end to end
    bounds: np.ndarray  #: where each text starts, and the end


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Slice]:
    """Runs of texts of about size bytes together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks] or [pa.array([], pa.large_string())])
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    codes = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(first, codes[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  #: index in the slice of each word's text
    counts: np.ndarray  #: words of each text


def words(codes: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    """Where the words of a slice lie; a text's end also ends a word."""
    n = len(codes)
    inside = ~separator[codes]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    at = np.searchsorted(starts, bounds)
    counts = np.diff(at)
    return Words(starts, ends, np.repeat(np.arange(len(counts)), counts), counts)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive word hashes, for every start at which n remain."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[k : k + m]
    return mix(out)


def shingles(h: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text indices of all n-word shingles; a text of fewer words, but at least one, is one shingle."""
    first = np.concatenate(([0], np.cumsum(counts)))
    grams = ngram_hashes(h, n)
    text = np.repeat(np.arange(len(counts)), counts)
    m = len(grams)
    whole = text[:m] == text[n - 1 : n - 1 + m] if m else np.zeros(0, dtype=bool)
    got, owner = grams[whole], text[:m][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([int(ngram_hashes(h[first[t] : first[t + 1]], int(counts[t]))[0]) ^ int(counts[t]) for t in short], dtype=np.uint64)
        got, owner = np.concatenate((got, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        got, owner = got[order], owner[order]
    return got, owner


def sequence_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of h[first[i]:first[i + 1]], equal for equal sequences of word hashes."""
    n = len(h)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _geometric(_BASE, n), out=prefix[1:])
    sums = (prefix[first[1:]] - prefix[first[:-1]]) * _geometric(_BASE_INV, n + 1)[first[:-1]]
    return mix(sums + np.diff(first).astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))


def simhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of the features h[first[i]:first[i + 1]]; 0 for none."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    n = np.diff(first)
    some = np.flatnonzero(n > 0)
    if len(some):
        # votes of eight bits at once, one to a byte of a word; up to 255 features can't overflow one
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        if n.max() < 256:
            ones = np.add.reduceat(bits.view(np.uint64), first[:-1][some], axis=0).view(np.uint8)
        else:
            ones = np.add.reduceat(bits, first[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones.astype(np.int32) > n[some][:, None], axis=1).view(np.uint64).ravel()
    return out
