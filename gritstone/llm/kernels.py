"""Vectorised text kernels on Arrow buffers: word hashes, shingles, MinHash, without a Python loop over words.

A polynomial hash modulo 2**64 with an odd base is a difference of prefix sums times a power of the base's
inverse, so all words of a megabyte of text are hashed in a handful of numpy passes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, _U)
    down = np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def folded() -> np.ndarray:
    """Byte table: lower-case letters, digits and all bytes of non-ASCII characters as words, 0 for what separates them."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or (b < 128 and c.isalnum()):
            t[b] = ord(c.lower()) if b < 128 else b
    return t


FOLD = folded()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0]


def windows(raw: np.ndarray, table: np.ndarray, size: int = WINDOW):
    """Spans of about ``size`` bytes that end where ``table`` has a separator (or after 2 * size bytes without one)."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + size)
        if b < n:
            gap = np.flatnonzero(table[raw[b : min(n, b + size)]] == 0)
            b = b + int(gap[0]) + 1 if len(gap) else min(n, b + size)
        yield a, b
        a = b


def runs(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every maximal run of bytes that ``table`` doesn't map to 0, none across two texts."""
    hashes, starts, sizes = [], [], []
    for a, b in windows(raw, table):
        c = table[raw[a:b]]
        inside = c != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [a, b])
        cut = offsets[lo:hi] - a
        cut = cut[cut < b - a]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        end = cut[cut > 0] - 1
        last[end] = inside[end]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if not len(s):
            continue
        up, down = _powers(2 * WINDOW + 2)
        total = np.cumsum(c * up[: b - a], dtype=_U)
        before = np.where(s > 0, total[s - 1], _U(0))
        hashes.append((total[e] - before) * down[s])
        starts.append(s + a)
        sizes.append(e - s + 1)
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.concatenate(sizes)
    return mix(np.concatenate(hashes) + sizes.astype(_U)), np.concatenate(starts), sizes


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the bounds of each text's; a text of fewer words has one shingle of them all, one without words none."""
    h, start, _ = runs(raw, offsets, FOLD)
    texts = len(offsets) - 1
    owner = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(owner, minlength=texts)
    pad = _U(0x1D8AF066D57E3D11)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # pad to n words
        ends = np.cumsum(counts)
        extra = n - counts[short]
        h = np.insert(h, np.repeat(ends[short], extra), pad)
        counts = counts.copy()
        counts[short] = n
    bounds = np.zeros(texts + 1, np.int64)
    np.cumsum(np.maximum(counts - (n - 1), 0), out=bounds[1:])
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(texts + 1, np.int64)
    g = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        g = g * _U(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
    ends = np.cumsum(counts)
    valid = np.ones(len(h), bool)
    for i in range(1, n):
        at = ends[counts > 0] - i
        valid[at] = False
    return mix(g[valid[: len(g)]]), bounds


@lru_cache(maxsize=4)
def _permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(1, 1 << 63, k, dtype=_U) * _U(2) + _U(1), r.integers(0, 1 << 63, k, dtype=_U)


def minhash(raw: np.ndarray, offsets: np.ndarray, words: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """MinHash samples (texts, k) of word shingles as uint32, and which texts have any shingle. Texts are taken a megabyte at a time."""
    mult, add = _permutations(k, seed)
    texts = len(offsets) - 1
    out = np.full((texts, k), 0xFFFFFFFF, np.uint32)
    some = np.zeros(texts, bool)
    a = 0
    while a < texts:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + WINDOW, "right")) - 1)
        g, bounds = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            some[a + full] = True
            best = None
            for lo in range(0, len(g), 1 << 18):  # a very long text in pieces; reduceat needs the texts' starts within the piece
                hi = min(len(g), lo + (1 << 18))
                at = np.searchsorted(bounds[full], lo, "right") - 1
                to = np.searchsorted(bounds[full], hi, "left")
                cuts = np.maximum(bounds[full[at:to]] - lo, 0)
                piece = g[lo:hi]
                low = np.empty((k, to - at), np.uint32)
                work = np.empty(hi - lo, _U)
                for j in range(k):
                    np.multiply(piece, mult[j], out=work)
                    work += add[j]
                    low[j] = np.minimum.reduceat(work, cuts) >> _U(32)
                if best is None:
                    best = np.full((len(full), k), 0xFFFFFFFF, np.uint32)
                best[at:to] = np.minimum(best[at:to], low.T)
            out[a + full] = best
        a = b
    return out, some
