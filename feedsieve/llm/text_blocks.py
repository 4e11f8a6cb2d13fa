"""Whole texts as byte blocks of bounded size, for numpy inside tasks."""

import numpy as np

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def to_bytes(text):
    """UTF-8 bytes of a text, none for null; half surrogate pairs are kept as they are."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def batches_of(texts, limit=BLOCK_BYTES):
    """Ranges ``(first, last + 1)`` of texts with about ``limit`` bytes together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_bounds(data):
    """Starts and ends of the words, which are the runs without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def lower_ascii(data):
    return _LOWER[data]


def powers(n, base):
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)
