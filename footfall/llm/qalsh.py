"""Approximate nearest neighbours by collision counting over query-centred windows.

Every shard keeps, for each of `projections` random lines, its vectors' values in sorted order. A query's window
on each line is centred on the query's own value; virtual rehashing widens all windows by one factor from round
to round, and only what a round adds is looked at. A vector that fell into the windows of at least `threshold` of
the lines is verified by its exact inner product.

Largest inner product becomes least distance when each vector gets one more component that brings all to the
same norm. A vector at distance d falls into a window of half-width h with probability 2 * Phi(h / d) - 1. Rounds end
when a vector at the distance of the k-th best one so far would have been verified with probability `recall`, or
when all vectors have been; there is no cap on candidates. A vector that ties with the threshold is verified.
"""

from __future__ import annotations

import math

import numpy as np

from footfall.llm.vectors import best_of


#: Bound on what single precision changes in a product, relative to the vectors' squared norms.
ROUNDING = 1e-5


def _tail(m: int, p: float, least: int) -> float:
    """P(at least `least` of m), each with probability p."""
    if p >= 1:
        return 1.0
    log_p, log_q = math.log(max(p, 1e-300)), math.log1p(-p)
    terms = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * log_p + (m - i) * log_q for i in range(least, m + 1)]
    return math.fsum(map(math.exp, terms))


def half_width(projections: int, threshold: int, recall: float) -> float:
    """Half-width, for distance 1, at which a vector is verified with probability `recall`."""
    low, high = 0.0, 10.0
    for _ in range(60):
        h = (low + high) / 2
        low, high = (h, high) if _tail(projections, math.erf(h / math.sqrt(2)), threshold) < recall else (low, h)
    return high


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed from the first component to the last, so that equal vectors have equal products."""
    return np.cumsum(rows * query, axis=1)[:, -1]


class CollisionIndex:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, projections: int = 24, threshold: int = 14, recall: float = 0.85, widen: float = 1.25, start: float = 0.5, seed: int = 5):
        self.rows, self.ids = rows, ids
        self.vectors, self.widen, self.threshold, self.start = vectors, widen, threshold, start
        norms = (vectors**2).sum(axis=1)
        self.norm = float(norms.max())
        self.rough = (vectors / math.sqrt(max(self.norm, 1e-300))).astype(np.float32)
        lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        self.lines = lines[:-1]
        values = vectors @ self.lines + np.sqrt(np.maximum(self.norm - norms, 0))[:, None] * lines[-1]
        self.order = np.argsort(values.T, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values.T, self.order.astype(np.int64), axis=1)
        # lines far enough apart that one sorted array holds them all; windows end within a line's own stretch
        self.span = float(np.abs(self.sorted).max()) * 4 + 1
        self.offsets = np.arange(projections) * self.span * 4
        self.firsts = np.arange(projections) * len(vectors)
        self.keys = (self.sorted + self.offsets[:, None]).ravel()
        self.reach = half_width(projections, threshold, recall)

    def _placed(self, at: np.ndarray) -> np.ndarray:
        """Of each line, how many values are below `at`: one search in the lines laid end to end."""
        return np.searchsorted(self.keys, np.clip(at, -self.span, self.span) + self.offsets) - self.firsts

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and products of the k best found, the row numbered `own` left out."""
        ids = self.ids
        n, m = len(ids), len(self.sorted)
        at = query @ self.lines
        counts = np.zeros(n, np.int32)
        done = self.rows == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        length = math.sqrt(float(query @ query))
        unit, rough = length * math.sqrt(self.norm), (query / max(length, 1e-300)).astype(np.float32)
        low = high = self._placed(at)
        size = float(query @ query) + self.norm
        width = self.reach * math.sqrt(max(size, 1e-300)) * self.start
        while True:
            left, right = np.minimum(self._placed(at - width), low), np.maximum(self._placed(at + width), high)
            edges = zip(range(m), left.tolist(), low.tolist(), high.tolist(), right.tolist(), strict=True)
            new = [self.order[j, a:b] for j, l, x, y, r in edges for a, b in ((l, x), (y, r)) if a < b]
            low, high = left, right
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            fresh = np.flatnonzero((counts >= self.threshold) & ~done)
            if len(fresh):
                done[fresh] = True
                rows = np.append(rows, fresh)
                scores = np.append(scores, (self.rough.take(fresh, axis=0) @ rough).astype(float) * unit)
                if len(rows) > k:  # what may be among the k best once products are exact
                    near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - ROUNDING * size
                    rows, scores = rows[near], scores[near]
            if done.all() or (low == 0).all() and (high == n).all():
                break
            if len(rows) >= k and width >= self.reach * math.sqrt(max(size - 2 * np.partition(scores, len(scores) - k)[len(scores) - k], 0)):
                break
            width *= self.widen
        scores = inner_products(self.vectors[rows], query)
        best = best_of(ids[rows], scores, k)
        return rows[best], scores[best]

    def find(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.search(x, number, k) for number, x in zip(own, queries, strict=True)]
        at = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
        return at, np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])
