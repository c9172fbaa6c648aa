"""Hashes of word shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: The inverse of the base modulo 2^64 (Newton's iteration).
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte (SplitMix64), A-Z as a-z."""
    x = np.arange(1, 257, dtype=np.uint64) * _MIX
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(m)
    x ^= x >> np.uint64(31)
    x[65:91] = x[97:123]
    return x


_VALUE = _byte_values()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse up to ``n``; those of common sizes are kept."""
    if n <= len(_powers[0]):
        return _powers[0], _powers[1]
    size = max(n, 1 << 16)
    made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    if size <= 1 << 21:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in ``data`` (bytes) and their hashes: words are split at ASCII white
    space and A-Z count as a-z. Hashes are polynomials of the bytes' values modulo 2^64."""
    w = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], w, [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)])])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MIX
    return start, _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _runs(w: np.ndarray, k: int) -> np.ndarray:
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    if len(h) < 2:
        return h
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingle_sets(texts: Iterator[bytes] | list[bytes], shingle: int, part: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``shingle`` words; a text with
    fewer words is one run, and one without words has none. Texts are worked on by about
    ``part`` bytes at a time, longer ones whole."""

    def made(held: list[bytes]) -> Iterator[np.ndarray]:
        begin = np.cumsum([0, *(len(t) + 1 for t in held)])
        start, w = word_hashes(np.frombuffer(b" ".join(held), np.uint8))
        at = np.searchsorted(start, begin)
        h = _runs(w, shingle) if len(w) >= shingle else w[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= shingle:
                yield _distinct(h[a : b - shingle + 1])
            else:
                yield _runs(w[a:b], b - a) if b > a else w[:0]

    held, size = [], 0
    for t in texts:
        if held and size + len(t) > part:
            yield from made(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield from made(held)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return next(shingle_sets([text], shingle))
