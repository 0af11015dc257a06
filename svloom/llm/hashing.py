"""Vectorised word and substring hashes of UTF-8 bytes or code points for the Python tasks."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SHIFT = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> _SHIFT)
    h = h * _M1
    h ^= h >> _SHIFT
    h *= _M2
    h ^= h >> _SHIFT
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums of mixed symbols times powers, modulo 2**64; one entry more than symbols."""
    values = mix(symbols.astype(np.uint64) + np.uint64(0x51ED27)) if symbols.dtype != np.uint8 else _BYTES[symbols]
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(values * _powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end] from prefix sums; equal contents give equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64) * _M2)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words of texts, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    hashes = range_hashes(prefix_sums(_LOWER[data]), start, end)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return hashes, counts


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted different hashes of k neighbouring words; of all words together if they are fewer."""
    if not len(words):
        return words
    k, h = min(k, len(words)), None
    n = len(words) - k + 1
    for j in range(k):
        part = words[j : j + n]
        h = part.copy() if h is None else mix(h * _P + part)
    return np.unique(mix(h + np.uint64(k)))
