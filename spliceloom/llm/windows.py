"""Winnowed windows of byte texts: which k-gram owns each window of fixed length."""

from __future__ import annotations

import hashlib

import numpy as np

from .shingles import mix

GRAM = 16
_PLACE = 24  # bits of a position
LONGEST = 1 << _PLACE
#: Windows of a text that are read together.
PIECE = 1 << 20


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position."""
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return mix(x[:-8] * np.uint64(0xA0761D6478BD642F) + mix(x[8:]))


def owners(raw: np.ndarray, length: int) -> np.ndarray:
    """Position of the gram that owns each window of ``length`` bytes: the one of least hash, the first of equals.

    It depends on the window's bytes alone, so equal windows are owned at equal offsets.
    """
    grams = gram_hashes(raw)
    span = length - GRAM + 1
    least = (grams & ~np.uint64(LONGEST - 1)) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return (least & np.uint64(LONGEST - 1)).astype(np.int64)


def digests(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit cryptographic digests of byte ranges, as two numbers each."""
    text = raw.tobytes()
    found = [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())]
    return np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2).astype(np.uint64)


def stretches(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one owner: (first window, last window, owner, gram hash, digest of all their bytes).

    Where the owner lies in them follows from the bytes. A text is read in
    pieces, and a run may be cut where a piece ends.
    """
    pieces = [_stretches(raw[a : a + PIECE + length - 1], length) for a in range(0, max(0, len(raw) - length + 1), PIECE)]
    if not pieces:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), np.zeros((0, 2), dtype=np.uint64)
    moved = [(f + k * PIECE, l + k * PIECE, o + k * PIECE, g, w) for k, (f, l, o, g, w) in enumerate(pieces)]
    return moved[0] if len(moved) == 1 else tuple(np.concatenate(c) for c in zip(*moved))


def _stretches(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    owner = owners(raw, length)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(owner)) - 1
    own = owner[first]
    return first, last, own, gram_hashes(raw)[own], digests(raw, first, last + length)
