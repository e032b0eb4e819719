"""Word shingles as sorted arrays of 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, A-Z lower-cased. A text's set holds its distinct n-word shingles; a
text with fewer words, but at least one, has its whole sequence as the one shingle; null, empty and blank texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", _BASE), ("down", _BACK)):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK), x, np.uint64)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _block_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up, dtype=np.uint64)])
    return start, mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash. The bytes are hashed in blocks that end between words."""
    at, starts, hashes = 0, [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data) and not _SPACE[data[end]]:
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
        s, h = _block_words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    take: list[bytes] = []
    size = 0
    for t in texts:
        take.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(take[-1])
        if size > 2 * BLOCK:
            yield from _sets(take, n)
            take, size = [], 0
    yield from _sets(take, n)


def _sets(coded: list[bytes], n: int) -> Iterator[np.ndarray]:
    if not coded:
        return
    starts, h = words(np.frombuffer(b" ".join(coded), np.uint8))
    firsts = np.cumsum([0, *(len(c) + 1 for c in coded)])[: len(coded)]
    cut = np.searchsorted(starts, np.append(firsts, firsts[-1] + len(coded[-1]) + 1))
    rolled = h[: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        rolled = mixed(rolled * _BASE + h[j : len(h) - n + 1 + j][: len(rolled)])
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(rolled[lo : hi - n + 1])
        elif hi > lo:
            one = np.uint64([hi - lo])
            for x in h[lo:hi]:
                one = mixed(one * _BASE + x)
            yield one
        else:
            yield np.empty(0, np.uint64)
