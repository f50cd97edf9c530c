"""Word shingles as 64-bit numbers, computed on the bytes of a text with NumPy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, 2 * len(_pow[0]))
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _pow[i] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


#: Bytes hashed at a time; a longer word is hashed in one piece.
SEGMENT = 1 << 20


def _hash_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte run, and where they start."""
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[2]), starts


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= SEGMENT:
        return _hash_words(b)
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + SEGMENT)
        while end < len(b) and not _SPACE[b[end]]:
            end += 1
        h, s = _hash_words(b[at:end])
        parts.append((h, s + at))
        at = end
    return np.concatenate([h for h, _ in parts]), np.concatenate([s for _, s in parts])


def _bytes(text: str | None, fold: bool) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_FOLD) if fold else raw


#: A-Z to a-z on bytes; bytes of longer characters never fall into that range.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_hashes(text: str | None, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, in order; A-Z count as a-z if ``fold``."""
    return _words(_bytes(text, fold))[0] if text else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], k: int = 5, fold: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words give the whole sequence, none an empty set.

    The texts are hashed as one byte run, so many short texts cost as little as one long text.
    """
    raw = [_bytes(t, fold) for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.cumsum(sizes) - sizes
    w, starts = _words(b"\n".join(raw)) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    begin = np.searchsorted(starts, first)
    end = np.append(begin[1:], len(w))
    h = np.full(max(0, len(w) - k + 1), k, np.uint64)
    for j in range(k if len(h) else 0):
        h = _scramble(h * _MIX[3] + w[j : len(w) - k + 1 + j])
    out = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for j in range(a, b):
                x = _scramble(x * _MIX[3] + w[j : j + 1])
            out.append(x)
        else:
            out.append(w[:0])
    return out


def shingle_set(text: str | None, k: int = 5, fold: bool = True) -> np.ndarray:
    return shingle_sets([text], k, fold)[0]
