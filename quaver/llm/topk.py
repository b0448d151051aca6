"""Exact maximum inner product search by ball trees."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.regions import nearest, usable

LEAF = 64
LONG = np.iinfo(np.int64)


class BallTree:
    """Balls over integer vectors: each node has a centre and a radius, each leaf at most ``LEAF`` rows (or equal rows)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((ids,))
        self.ids, self.rows = ids[order], rows[order]
        # sums of products below 2**53 are exact in doubles; else Python's integers
        top = float(np.abs(self.rows.astype(np.float64)).max(initial=0.0))
        self.top, self.dim = top, rows.shape[1]
        self.points = self.rows.astype(np.float64)
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.span: list[np.ndarray] = []
        self._build(np.arange(len(ids)))

    def _build(self, some: np.ndarray) -> int:
        p = self.points[some]
        centre = p.mean(0)
        far = np.sqrt(((p - centre) ** 2).sum(1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(far.max()) * (1 + 1e-9) + 1e-6)
        self.children.append(None)
        self.span.append(some)
        if len(some) > LEAF and self.radius[node] > 1e-5:
            a = p[far.argmax()]
            to_a = ((p - a) ** 2).sum(1)
            b = p[to_a.argmax()]
            side = np.argsort(((p - b) ** 2).sum(1) - to_a, kind="stable")
            half = len(some) // 2
            self.children[node] = (self._build(some[np.sort(side[half:])]), self._build(some[np.sort(side[:half])]))
        return node

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of rows whose id isn't ``own``, best first; none below ``floor``, a k-th score known from elsewhere."""
        q = query.astype(np.float64)
        norm = float(np.sqrt((q * q).sum()))
        exact = self.top * float(np.abs(q).max(initial=0.0)) * self.dim < 2**53
        if not hasattr(self, "_c"):
            self._c, self._r = np.array(self.centre), np.array(self.radius)
        upper = self._c @ q + norm * self._r
        upper += 1e-9 * np.abs(upper) + 1e-6  # rounding never hides a row
        kth = -np.inf if floor is None else floor  # an integer: as a double it could be above rows of the same score
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        open_nodes = [(-upper[0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < kth:
                break
            if kids := self.children[node]:
                for c in kids:
                    if upper[c] >= kth:
                        heapq.heappush(open_nodes, (-upper[c], c))
                continue
            some = self.span[node]
            if exact:
                score = (self.points[some] @ q).astype(np.int64)
            else:
                score = (self.rows[some].astype(object) * query.astype(object)).sum(1).clip(LONG.min, LONG.max)
            for i in np.flatnonzero((score >= kth) & (self.ids[some] != own)):
                item = (int(score[i]), -int(self.ids[some[i]]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _upper(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    return centres @ q + np.sqrt(q @ q) * radii


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 8192) -> DataFrame:
    """Each query's k highest integer inner products with all other rows: query_id, rank, vec_id, score.

    ``is_query``: a condition on vec_id. Components become floor(scale * x); vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part, nor do pairs of different length. Ties go to the smaller
    vec_id. Rows that share the query's vec_id are its own; other repeated rows are separate candidates, and each repeated query row has
    ranks of its own. Scores are exact integers; components and scores that a long can't hold are held at its ends (and tie there).
    An empty table gives an empty result; extra columns are ignored.

    ``regions.nearest`` deals rows to shards and queries to the shards that can reach their k-th score; each shard has a ball tree.
    """
    clean = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return nearest(clean, is_query, k, shard_rows, BallTree, lambda rows: rows.astype(np.float64), _upper, np.int64, "long")
