"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(717)
_BYTE = _rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)       # odd, 5 mod 8
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int):
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) of a batch of texts, and per text
    the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:n]
    starts = np.flatnonzero(starts)
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    ends = np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``k`` words; fewer
    words count as one run as a whole; none as no run."""
    h, first = word_hashes(data, offs)
    runs = h + np.uint64(k)
    for j in range(1, k):
        nxt = np.zeros_like(h)
        nxt[:-j] = h[j:]
        runs = mix64(runs * np.uint64(0xD6E8FEB86659FD93) + nxt)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(runs[a:z - k + 1]))
        elif z > a:
            one = np.array([z - a], np.uint64)
            for i in range(a, z):
                one = mix64(one * np.uint64(0xA0761D6478BD642F) + h[i:i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
