"""Regions of text that own the windows in which a repeat can start.

A window is any string of ``width`` bytes. Its mark is the least hash of the
``gram``-byte strings inside, so equal windows have equal marks, wherever they
stand. A region is a run of window starts of one document with one mark.
"""

from __future__ import annotations

import numpy as np
import xxhash

CHUNK = 1 << 20
LONGEST = 512

_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram (a power of two) at each start, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _MUL[0]
    h ^= h >> np.uint64(29)
    size, k = 1, 0
    while size < gram:
        h = h[:-size] * _MUL[k % 6] + (h[size:] ^ (h[:-size] >> np.uint64(31)))
        size, k = 2 * size, k + 1
    h *= _MUL[1]
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    m = h
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def second_marks(raw: bytes, width: int = 200, gram: int = 32) -> np.ndarray:
    """For each window of ``raw`` the least of another hash of its grams."""
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    return sliding_min((h ^ (h >> np.uint64(31))) * _MUL[2], width - gram + 1)


def regions(raw: bytes, width: int = 200, gram: int = 32) -> list[tuple[int, int, int, int, bool]]:
    """(mark, hash, first start, starts, has the mark more than once) of each region."""
    out = []
    last = len(raw) - width
    data = np.frombuffer(raw, np.uint8)
    inner = width - gram + 1
    for at in range(0, last + 1, CHUNK):
        n = min(CHUNK, last + 1 - at)
        h = gram_hashes(data[at : at + n + width - 1], gram)
        m = sliding_min(h, inner)
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
        first = [0, *cuts.tolist()]
        ends = [*first[1:], n]
        marks = m[first].astype(np.int64).tolist()
        for a, z, mark, um in zip(first, ends, marks, m[first]):
            for s in range(a, z, LONGEST):
                e = min(z, s + LONGEST)
                twice = np.count_nonzero(h[s : e - 1 + inner] == um) > 1
                text = raw[at + s : at + e - 1 + width]
                out.append((mark, xxhash.xxh3_64_intdigest(text) - (1 << 63), at + s, e - s, twice))
    return out
