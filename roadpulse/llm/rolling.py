"""Hashes of all windows of a byte buffer, by doubling: the hash of 2m bytes
is made of those of two halves, so a window of 2^j bytes takes j steps over
the whole buffer and no state runs along it."""

from __future__ import annotations

import numpy as np

BASE = 0x9FB21C651E98DF25  # odd
WRAP = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64))


def doubled(data: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of all windows of 1, 2, 4 ... up to ``longest`` bytes."""
    out = {1: LETTERS[data]}
    m = 1
    while 2 * m <= longest and len(out[m]) > m:
        out[2 * m] = out[m][:-m] * np.uint64(pow(BASE, m, WRAP)) + out[m][m:]
        m *= 2
    return out


def window_hashes(levels: dict[int, np.ndarray], length: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ``length`` bytes at the positions ``at``."""
    total, done = np.zeros(len(at), np.uint64), 0
    for bit in reversed(range(length.bit_length())):
        m = 1 << bit
        if length & m:
            total = total * np.uint64(pow(BASE, m, WRAP)) + levels[m][at + done]
            done += m
    return mix(total)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m = 1
    while 2 * m <= width:
        v = np.minimum(v[:-m], v[m:])
        m *= 2
    rest = width - m
    return np.minimum(v[:-rest], v[rest:]) if rest else v
