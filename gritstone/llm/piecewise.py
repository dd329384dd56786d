"""Context-triggered piecewise hashing: document fingerprints that compare by edit distance."""

from __future__ import annotations

import numpy as np
import xxhash

LEAST_BLOCK, LENGTH, GRAM = 3, 64, 7
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHAR = np.frombuffer(ALPHABET, np.uint8)
_STEP = 1 << 20


def rolling(c: np.ndarray) -> np.ndarray:
    """A hash of the last seven bytes at each place; places before the text count as 0."""
    x = np.zeros(len(c) + 6, np.uint32)
    x[6:] = c
    n = len(c)
    h = x[:n] + np.uint32(1)
    for i in range(1, 7):
        h *= np.uint32(0x01000193)
        h += x[i : i + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def boundaries(c: np.ndarray, block: int) -> np.ndarray:
    """Places after which a chunk ends."""
    out = []
    for a in range(0, len(c), _STEP):
        before = min(a, 6)
        h = rolling(c[a - before : a + _STEP])[before:]
        out.append(np.flatnonzero(h % np.uint32(block) == block - 1) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(c: np.ndarray, ends: np.ndarray) -> str:
    """One character for each chunk; what lies beyond the last of ``LENGTH`` belongs to that."""
    ends = ends[: LENGTH - 1]
    cuts = [0, *(ends + 1).tolist()]
    if cuts[-1] < len(c):
        cuts.append(len(c))
    digest = xxhash.xxh64_intdigest
    return bytes(ALPHABET[digest(c[a:b]) >> 58] for a, b in zip(cuts, cuts[1:])).decode()


def fingerprint(c: np.ndarray) -> tuple[int, str, str]:
    """Block size, and the signatures at it and at its double. The block size is the largest of 3 * 2**i that makes at least half of ``LENGTH`` chunks, starting from the least that couldn't make more than ``LENGTH`` evenly."""
    block = LEAST_BLOCK
    while block * LENGTH < len(c):
        block *= 2
    ends = boundaries(c, block)
    while len(ends) < LENGTH // 2 - 1 and block > LEAST_BLOCK:
        block //= 2
        ends = boundaries(c, block)
    return block, chunks(c, ends), chunks(c, boundaries(c, 2 * block))
