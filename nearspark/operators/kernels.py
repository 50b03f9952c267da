"""numpy kernels on blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Ranking distances of every query to every row."""
    if metric == "inner_product":
        return -(q @ v.T)
    if metric == "cosine":
        dot = q @ v.T
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        return np.where(norm > 0, 1 - dot / np.where(norm > 0, norm, 1), 1.0)
    # around the rows' mean, so that what all vectors have in common doesn't eat up the digits
    centre = v.mean(axis=0) if len(v) else 0.0
    q, v = q - centre, v - centre
    return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0)


def smallest(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the positions and values of the k smallest, ties to the smaller id."""
    k = min(k, dist.shape[1])
    order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :k] if dist.shape[1] <= 4 * k else None
    if order is None:
        cut = np.partition(dist, k - 1, axis=1)[:, k - 1]
        order = np.empty((len(dist), k), np.int64)
        for i in range(len(dist)):
            at = np.flatnonzero(dist[i] <= cut[i])
            order[i] = at[np.lexsort((ids[at], dist[i, at]))[:k]]
    return order, np.take_along_axis(dist, order, axis=1)


def best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, metric: str, margin: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of each query's k nearest rows; squared L2 of the nearest few is summed up directly, and they are ranked by that."""
    at, found = smallest(distances(q, v, metric), ids, k + margin if metric == "l2" else k)
    if metric != "l2":
        return at, found
    found = np.stack([((v[rows] - x) ** 2).sum(axis=1) for x, rows in zip(q, at)]) if len(q) else found
    order = np.lexsort((ids[at], found), axis=1)[:, :k]
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(found, order, axis=1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centroid, ties to the lower index."""
    d = distances(v, centroids, "l2")
    at = d.argmin(axis=1)
    return at, d[np.arange(len(v)), at]


def kmeans(v: np.ndarray, k: int, rounds: int = 25, seed: int = 1234, weight: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's algorithm from k-means++ (or ``start``), with repair of empty clusters. n <= k repeats rows."""
    if rounds < 1:
        raise ValueError("at least one round is needed")
    if not len(v):
        raise ValueError("no training vectors")
    if len(v) <= k:
        return v[np.arange(k) % len(v)].copy()
    rng = np.random.default_rng(seed)
    w = np.ones(len(v)) if weight is None else weight
    if start is None:
        c = np.empty((k, v.shape[1]))
        c[0] = v[rng.choice(len(v), p=w / w.sum())]
        best = ((v - c[0]) ** 2).sum(1)
        for i in range(1, k):
            p = best * w
            c[i] = v[rng.choice(len(v), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(v))]
            best = np.minimum(best, ((v - c[i]) ** 2).sum(1))
    else:
        c = start.copy()
    before = np.inf
    for _ in range(rounds):
        at, d = nearest(v, c)
        c = update(v, at, c, w, rng)
        now = float((d * w).sum())
        if abs(before - now) < 1e-6 * max(before, 1e-300):
            break
        before = now
    return c


def update(v: np.ndarray, at: np.ndarray, c: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weighted means; an empty cluster takes half of the largest one, slightly moved apart."""
    size = np.bincount(at, w, len(c))
    out = np.stack([np.bincount(at, v[:, j] * w, len(c)) for j in range(v.shape[1])], axis=1) / np.where(size > 0, size, 1)[:, None]
    sign = np.where(np.arange(v.shape[1]) % 2 == 0, 1.0, -1.0) / 1024
    for i in np.flatnonzero(size == 0):
        big = int(size.argmax())
        out[i], out[big] = out[big] * (1 + sign), out[big] * (1 - sign)
        size[i] = size[big] = size[big] / 2
    return out


def hierarchical_kmeans(v: np.ndarray, k: int, seed: int = 1234) -> np.ndarray:
    """16 clusters first, then the largest is split in two until there are k. For k > 256."""
    c = kmeans(v, min(16, k), seed=seed)
    at, _ = nearest(v, c)
    groups = [np.flatnonzero(at == i) for i in range(len(c))]
    cents = list(c)
    while len(cents) < k:
        i = max(range(len(groups)), key=lambda j: len(groups[j]))
        if len(groups[i]) < 2:
            break
        two = kmeans(v[groups[i]], 2, 10, seed)
        side, _ = nearest(v[groups[i]], two)
        a, b = groups[i][side == 0], groups[i][side == 1]
        if not len(a) or not len(b):
            a, b = np.array_split(groups[i], 2)
        groups[i], cents[i] = a, v[a].mean(0)
        groups.append(b)
        cents.append(v[b].mean(0))
    return np.stack([cents[i % len(cents)] for i in range(k)])


def train_centroids(v: np.ndarray, k: int, seed: int = 1234) -> np.ndarray:
    return hierarchical_kmeans(v, k, seed) if k > 256 and len(v) > k else kmeans(v, k, seed=seed)


class ProductQuantizer:
    """Sub-spaces of (nearly) equal width, each with its own codebook."""

    def __init__(self, offsets: list[int], books: list[np.ndarray], bits: int = 8):
        self.offsets, self.books, self.bits = offsets, books, bits

    @classmethod
    def train(cls, v: np.ndarray, m: int, bits: int = 8, seed: int = 1234, rounds: int = 25) -> ProductQuantizer:
        d = v.shape[1]
        offsets = np.concatenate([[0], np.cumsum([d // m + (i < d % m) for i in range(m)])]).tolist()
        return cls(offsets, [kmeans(v[:, a:b], 1 << bits, rounds, seed + i) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))], bits)

    def encode(self, v: np.ndarray) -> np.ndarray:
        return np.stack([nearest(v[:, a:b], c)[0] for a, b, c in zip(self.offsets, self.offsets[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.books)], axis=1)

    def table(self, q: np.ndarray, metric: str) -> np.ndarray:
        """table[sub][code]: squared L2 (also for cosine) or negative inner product."""
        how = "inner_product" if metric == "inner_product" else "l2"
        return np.stack([distances(q[None, a:b], c, how)[0] for a, b, c in zip(self.offsets, self.offsets[1:], self.books)])

    @staticmethod
    def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(table.shape[0]), codes].sum(axis=1)


def pack4(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte, the even one in the low half."""
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def unpack4(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)


def train_opq(v: np.ndarray, m: int, bits: int = 8, rounds: int = 20, seed: int = 1234) -> np.ndarray:
    """An orthogonal matrix R; rotated rows v @ R.T have smaller quantization error."""
    rng = np.random.default_rng(seed)
    x = v - v.mean(0)
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        y = x @ r.T
        pq = ProductQuantizer.train(y, m, bits, seed, 4)
        u, _, vt = np.linalg.svd(x.T @ pq.decode(pq.encode(y)))
        r = (u @ vt).T
    return r


def pack_planes(levels: np.ndarray, bits: int) -> np.ndarray:
    """Levels of so many bits as bit planes, the lowest first: one bit of each component in a plane."""
    return np.concatenate([np.packbits(levels >> b & 1, axis=1) for b in range(bits)], axis=1)


def unpack_planes(planes: np.ndarray, bits: int) -> np.ndarray:
    width = planes.shape[1] // bits
    out = np.zeros((len(planes), width * 8), np.uint8)
    for b in range(bits):
        out |= np.unpackbits(planes[:, b * width : (b + 1) * width], axis=1) << b
    return out


class RotatedQuantizer:
    """Bit-plane codes of randomly rotated vectors with an unbiased inner-product estimate."""

    def __init__(self, d: int, bits: int = 4, seed: int = 0x9E3779B97F4A7C15):
        self.d, self.bits, self.padded = d, bits, -(-d // 64) * 64
        rng = np.random.default_rng(seed ^ d)
        h = np.ones((1, 1))
        while len(h) < 64:
            h = np.block([[h, h], [h, -h]])
        block = np.kron(np.eye(self.padded // 64), h * 0.125)
        r = np.eye(self.padded)
        for _ in range(4):
            r = (block @ (rng.choice([-1.0, 1.0], self.padded)[:, None] * r))[rng.permutation(self.padded)]
        self.rotation = r

    def rotate(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.padded - self.d))) @ self.rotation.T

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels per component, and (scale, norm, error) of each row."""
        x = self.rotate(residual)
        top = (1 << self.bits) - 1
        norm = np.sqrt((x * x).sum(1))
        if self.bits == 1:
            levels = (x >= 0).astype(np.uint8)
            grid = levels * 2.0 - 1
        else:
            scale = np.abs(x).max(1, keepdims=True) / (top / 2)
            scale[scale == 0] = 1
            for _ in range(3):  # the scale that fits the levels best
                levels = np.clip(np.round(x / scale + top / 2), 0, top)
                g = levels - top / 2
                fit = (x * g).sum(1, keepdims=True) / np.maximum((g * g).sum(1, keepdims=True), 1e-12)
                scale = np.where(fit > 0, fit, scale)
            levels = np.clip(np.round(x / scale + top / 2), 0, top).astype(np.uint8)
            grid = levels - top / 2
        along = (x * grid).sum(1)
        factor = np.where(np.abs(along) > 0, norm**2 / np.where(along == 0, 1, along), 0.0)
        cos = np.where(norm > 0, along / np.maximum(norm * np.sqrt((grid * grid).sum(1)), 1e-12), 1.0)
        error = norm * np.sqrt(np.maximum(1 - cos**2, 0)) / np.maximum(cos, 1e-12)
        return levels, np.stack([factor, norm, error], axis=1)

    def inner(self, rotated_query: np.ndarray, levels: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Estimates of <query, residual>."""
        grid = levels * 2.0 - 1 if self.bits == 1 else levels - ((1 << self.bits) - 1) / 2
        return factors[:, 0] * (grid @ rotated_query)
