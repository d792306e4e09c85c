"""Word shingles of whole texts as sets of 64-bit hashes, computed over many texts at once.

Words are runs of bytes that aren't ASCII white space; A-Z count as a-z. A word's hash is a sum over its bytes of a
random number times a power of an odd base, taken as a difference of running sums; a shingle's is a mixed weighted sum over
its words' hashes. A text with fewer words than a shingle has one, of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import kept, mix64, slices

WIDTH, SEED = 5, 90_001

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i below n."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            done, step = done + k, step * step % (1 << 64)
    return out


#: Powers are kept for buffers up to this many bytes; longer texts get their own.
_KEPT = 3 << 19
_tables: list[np.ndarray] = kept([])


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _KEPT:
        return powers(_BASE, n), powers(_INVERSE, n)
    if not _tables:
        _tables.extend((powers(_BASE, _KEPT), powers(_INVERSE, _KEPT)))
    return _tables[0][:n], _tables[1][:n]


def some(raw: list[bytes], width: int) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in raw], np.int64)
    text = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
    begin = np.r_[0, np.cumsum(sizes + 1)]
    gap = _SPACE[text]
    edge = np.flatnonzero(np.diff(np.r_[True, gap]))
    start, end = edge[::2], edge[1::2]
    up, down = tables(len(text) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[text] * up[:-1], out=total[1:])
        word = mix64((total[end] - total[start]) * down[start])
        first = np.searchsorted(start, begin)
        n = len(word) - width + 1
        shingle = np.zeros(max(n, 0), np.uint64)
        for k in range(width):
            shingle += word[k : k + max(n, 0)] * _PLACE[k]
        shingle = mix64(shingle)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(shingle[a : b - width + 1]))
            elif b > a:
                short = (word[a:b] * _PLACE[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix64(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sets(raw: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for s in slices(map(len, raw)):
        yield from some(raw[s], width)


def key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that two sets share if they are equal, as two signed longs; (0, 0) for the empty set."""
    if not len(shingles):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix64(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
        b = mix64(shingles ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))
