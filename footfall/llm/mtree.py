"""Exact top-k by inner product over integer vectors, with best-first search in M-trees.

Each shard is one tree of pages. An entry of an inner page has a routing vector, the covering radius of what lies
below it and its distance to the page's own routing vector; a leaf's entries have their distance to the leaf's.
One more component brings all vectors to the same norm, so the largest inner product is the least distance and the
triangle inequality holds. A page is opened only while its lower bound may still beat the k-th best; entries whose
stored parent distance already rules them out are skipped without computing anything.

The queries of a block go down the tree side by side: each opens the page of its own least bound next, and those
that open the same page share one matrix product. Bounds are floating-point with a slack, scores are exact integers;
entries that tie with the k-th best are opened. What a query found before it came here bounds it from the start.
Scores beyond a long do not fit the result and raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.llm.vectors import Build

SLACK = 1e-6
LEAF = 128
FANOUT = 12


@dataclass
class Page:
    """rows: a leaf's entries, or the routing vectors of an inner page's entries, which are the pages `below`."""

    rows: np.ndarray
    parent_distance: np.ndarray
    radius: np.ndarray | None = None
    below: np.ndarray | None = None


class MTree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, seed: int = 3):
        """vectors: whole numbers; exact in double precision below 2**53, else kept as Python integers."""
        self.rows, self.ids, self.computed = rows, ids, 0
        exact = float(np.abs(vectors.astype(float)).max(initial=0)) ** 2 * vectors.shape[1] * 4 < 2**52
        self.vectors = vectors.astype(float) if exact else np.array([[int(c) for c in x] for x in vectors], object)
        plain = vectors.astype(float)
        norms = (plain**2).sum(axis=1)
        self.norm = float(norms.max())
        self.space = np.column_stack([plain, np.sqrt(np.maximum(self.norm - norms, 0))])
        self._random = np.random.default_rng(seed)
        self.pages: list[Page] = []
        self.root = self._built(np.arange(len(vectors)), 0)

    def _distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.space[rows] - self.space[to]) ** 2).sum(axis=1))

    def _built(self, rows: np.ndarray, parent: int) -> int:
        """Number of the page over these rows, whose routing vector is `parent`."""
        if len(rows) <= LEAF:
            self.pages.append(Page(rows, self._distance(rows, parent)))
            return len(self.pages) - 1
        routes = self._random.choice(rows, FANOUT, replace=False)
        gaps = np.stack([self._distance(rows, r) for r in routes])
        nearest = gaps.argmin(axis=0)
        if np.bincount(nearest, minlength=FANOUT).max() > 0.9 * len(rows):
            nearest = np.arange(len(rows)) % FANOUT  # many equal vectors: deal them out
        used = [i for i in range(FANOUT) if (nearest == i).any()]
        below = [self._built(rows[nearest == i], int(routes[i])) for i in used]
        kept = routes[used]
        self.pages.append(Page(kept, self._distance(kept, parent), np.array([gaps[i, nearest == i].max() for i in used]), np.array(below)))
        return len(self.pages) - 1

    def find(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, row positions and exact scores of each query's k best of at least `least`."""
        ids = self.ids
        n = len(queries)
        q = queries.astype(float)
        exact = q if self.vectors.dtype != object else np.array([[int(c) for c in x] for x in queries], object)
        size = (q**2).sum(axis=1) + self.norm
        slack = SLACK * (1 + np.sqrt(size))

        def away(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(at) * len(rows)
            return np.sqrt(np.maximum(size[at, None] - 2 * (q[at] @ self.space[rows, :-1].T), 0))

        bound = np.full((n, len(self.pages)), np.inf)
        distance = np.zeros((n, len(self.pages)))
        bound[:, self.root], distance[:, self.root] = 0, away(np.arange(n), np.array([0]))[:, 0]
        least = least.astype(float).copy()
        limit = np.sqrt(np.maximum(size - 2 * least, 0))
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)]  # query, row, score
        active = np.arange(n)
        while len(active):
            page = bound[active].argmin(axis=1)
            nearest = bound[active, page]
            go = (nearest < np.inf) & (nearest <= limit[active] + slack[active])
            active, page = active[go], page[go]
            order = np.argsort(page, kind="stable")
            fresh = [best]
            for group in np.split(order, np.flatnonzero(np.diff(page[order])) + 1) if len(order) else ():
                at, number = active[group], int(page[group[0]])
                own_page = self.pages[number]
                reach = np.abs(distance[at, number][:, None] - own_page.parent_distance)
                edge = (limit[at] + slack[at])[:, None]
                if own_page.below is None:
                    wanted = reach <= edge
                    rows = own_page.rows[wanted.any(axis=0)]
                    scores = exact[at] @ self.vectors[rows].T
                    self.computed += len(at) * len(rows)
                    hit, col = np.nonzero(wanted[:, wanted.any(axis=0)] & (scores >= least[at][:, None]) & (self.rows[rows] != own[at][:, None]))
                    fresh.append([at[hit], rows[col], scores[hit, col]])
                else:
                    open_ = reach - own_page.radius <= edge
                    gaps = away(at, own_page.rows)
                    low = np.maximum(gaps - own_page.radius, bound[at, number][:, None])
                    bound[at[:, None], own_page.below] = np.where(open_, low, np.inf)
                    distance[at[:, None], own_page.below] = gaps
                bound[at, number] = np.inf
            if len(fresh) > 1:
                who, row, score = (np.concatenate(x) for x in zip(*fresh, strict=True))
                order = np.lexsort((ids[row], -score, who))
                who, row, score = who[order], row[order], score[order]
                starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
                rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
                kept = rank < k
                best = [who[kept], row[kept], score[kept]]
                last = np.flatnonzero(rank == k - 1)
                least[who[last]] = score[last].astype(float)
                limit[who[last]] = np.sqrt(np.maximum(size[who[last]] - 2 * score[last].astype(float), 0))
        return best[0], best[1], best[2]


def rounded(vector: Column, scale: float = 64.0) -> Column:
    """Components scaled and rounded down to whole numbers, which stay doubles whatever their size."""
    return F.transform(vector, lambda x: x * scale - F.pmod(x * scale, F.lit(1.0)))


build: Build = MTree
