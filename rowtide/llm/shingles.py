"""Sets of word n-grams as sorted numbers, computed for whole batches of bytes at a time."""

from __future__ import annotations

import hashlib

import numpy as np

TOKEN_BITS = 58  # the six bits above hold a class of frequency where order matters


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BYTES = _scrambled((_LOWER + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD1342543DE82EF95)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of all texts, and the text it is in."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    full = ~BLANK[data]
    edges = np.diff(full.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP))
    hashes = _scrambled(np.add.reduceat(_BYTES[data[full]] * powers[within], first))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(limits, starts, "right")


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of words, lower-cased from A to Z, for each text.

    A text with fewer words than ``width`` has its whole sequence as its one n-gram; without
    words the set is empty.
    """
    hashes, owner = _words([(t or "").encode() for t in texts])
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    factors = np.cumprod(np.full(width, np.uint64(0xA0761D6478BD642F)))
    grams = np.zeros(0, np.uint64)
    if len(hashes) >= width:
        grams = sum(hashes[k : len(hashes) - width + 1 + k] * factors[k] for k in range(width))
        grams = _scrambled(grams + np.uint64(width)) >> np.uint64(64 - TOKEN_BITS)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_scrambled(np.array([short])) >> np.uint64(64 - TOKEN_BITS))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
