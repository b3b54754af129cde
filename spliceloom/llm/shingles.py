"""Hashes of words and word n-grams, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_229)
_ODD = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text hashed together.
_CHUNK = 400_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_chunk(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts (A-Z lower-cased) that lie end to end, and where each text's words begin.

    A word is cut into lanes of 8 bytes. Each lane is mixed with its place before
    the lanes are added, so no sum of bytes of one word makes up for another's.
    """
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lanes = (ends - starts + 7) // 8
    begins = np.cumsum(lanes) - lanes
    word = np.repeat(np.arange(len(starts)), lanes)
    place = np.arange(len(word)) - begins[word]
    at = starts[word] + 8 * place
    padded = np.concatenate((_LOWER[raw], np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))[at]
    eight &= np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(8, ends[word] - at))).astype(np.uint64)
    values = mix(eight + place.astype(np.uint64) * _PLACE)
    return mix(np.add.reduceat(values, begins) + (ends - starts).astype(np.uint64) * _LENGTH), counts


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK)) - 1)
        hashes, counts = _hash_chunk(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            yield hashes[counts[k] : counts[k + 1]]
        i = j


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; fewer words than that are one run, no words none."""
    if not len(words):
        return words
    m = min(n, len(words))
    total = np.full(len(words) - m + 1, m, dtype=np.uint64)
    for k in range(m):
        total += words[k : len(words) - m + 1 + k] * _ODD[k]
    return mix(total)


def plain_words(text: str) -> list[bytes]:
    """The words themselves, in UTF-8: white space and letter case of bytes are those of the contracts."""
    return text.encode().lower().split()


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sets of word n-grams of texts of single-spaced words, as numbers that are equal only for equal words.

    Words are numbered as they appear. A gram's word numbers are joined to one
    number, and renumbered by rank whenever the next would not fit 64 bits. Fewer
    than ``n`` words are one gram, filled up with 0.
    """
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number) + 1) for w in t.split(b" ")] if t else [] for t in texts]
    fill = [0] * (n - 1)
    flat = np.array([x for w in words for x in (*w, *fill)], dtype=np.uint64)
    begins = np.cumsum([0, *(len(w) + n - 1 for w in words)])
    counts = [max(len(w) - n + 1, min(1, len(w))) for w in words]
    at = np.concatenate([np.arange(b, b + c) for b, c in zip(begins, counts)]) if counts else np.zeros(0, dtype=np.int64)
    grams, high, base = flat[at], len(number) + 1, len(number) + 1
    for k in range(1, n):
        if high * base >= 1 << 64:
            distinct, grams = np.unique(grams, return_inverse=True)
            grams, high = grams.astype(np.uint64), len(distinct)
        grams = grams * np.uint64(base) + flat[at + k]
        high *= base
    return [np.unique(g) for g in np.split(grams, np.cumsum(counts)[:-1])] if counts else []
