"""Vectorised hashing of words and word shingles over concatenated UTF-8 bytes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, 2, dtype=np.uint64) | U(1)
_STEP = np.random.default_rng(20240608).integers(1, 1 << 63, 16, dtype=np.uint64) | U(1)
#: Bits of a word's first 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this many bytes are hashed by BLAKE2b.
LONG = 256

#: Byte classes: words of the contracts end at ASCII white space, A-Z counts as a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters for feature words: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[65:91] = True
LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros beyond the end), as little-endian numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time, each step mixed before the next, so that no texts collide by their structure."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ _SEEDS[seed])
    eights, at, k = _eights(data), np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(at):
        x = eights[start[at] + k] & _KEEP[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] ^ x * U(0xC2B2AE3D27D4EB4F))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=b"%d" % seed).digest(), "little")
    return h


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, to_start: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the one beside it."""
    size = end - start
    same = size == to_end - to_start
    eights, at, k = _eights(data), np.flatnonzero(same & (size > 0) & (start != to_start)), 0
    while len(at):
        differ = (eights[start[at] + k] ^ eights[to_start[at] + k]) & _KEEP[np.minimum(size[at] - k, 8)] != 0
        same[at[differ]] = False
        k += 8
        at = at[~differ & (size[at] > k)]
    return same


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``inside``, the row of each, and the first word of each row (one more at the end)."""
    start, end = spans(inside)
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return span_hash(data, start, end, seed), row, first


def shingles(data: np.ndarray, off: np.ndarray, n: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the distinct hashes of n-word shingles (n at most 16), ascending: hashes, row of each, first of each row.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    low = LOWER[data]
    w, row, first = words(low, off, ~SPACE[low], seed)
    count = np.diff(first)
    full = np.zeros(len(w), bool)
    if len(w) >= n:
        full[: len(w) - n + 1] = row[: len(w) - n + 1] == row[n - 1 :]
    at = np.flatnonzero(full)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h += w[at + k] * _STEP[k]
    h = mix(h)
    short = np.flatnonzero((count > 0) & (count < n))
    part = count[short].astype(np.uint64) * _STEP[7]
    for k in range(n - 1):
        more = count[short] > k
        part[more] = mix(part[more] * _STEP[1] + w[first[short[more]] + k])
    h, r = np.concatenate([h, part]), np.concatenate([row[at], short])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, r, np.searchsorted(r, np.arange(len(off)))
