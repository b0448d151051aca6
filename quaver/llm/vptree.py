"""Approximate nearest neighbours by cosine: vantage-point trees with relaxed pruning."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.regions import nearest, usable

LEAF = 64


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its squares neither overflow nor vanish; that changes no digit of a cosine."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])


def _units(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


class VantageTree:
    """Unit vectors around vantage points: the nearer half inside, the other outside, each with its least and largest distance."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, relax: float) -> None:
        self.relax, self.rows = relax, _scaled(rows)
        self.norms = np.sqrt((self.rows * self.rows).sum(1))
        self.units = self.rows / self.norms[:, None]
        self.vantage: list[np.ndarray] = []
        self.children: list[tuple] = []  # (child, least, largest distance of its rows to the vantage point); none: a leaf
        self.span: list[slice] = []  # of a leaf's rows in the final order
        order: list[np.ndarray] = []
        self._build(np.argsort(ids, kind="stable"), order, 0)
        last = np.concatenate(order)
        self.ids, self.rows, self.norms = ids[last], self.rows[last], self.norms[last]

    def _build(self, some: np.ndarray, order: list[np.ndarray], start: int) -> int:
        node, p = len(self.span), self.units[some]
        v = p[((p - p.mean(0)) ** 2).sum(1).argmax()]  # the row farthest out parts its halves best
        d = np.sqrt(((p - v) ** 2).sum(1))
        self.vantage.append(v)
        self.children.append(())
        self.span.append(slice(start, start + len(some)))
        if len(some) <= LEAF or d.max() == d.min():
            order.append(some)
            return node
        near = d <= np.median(d)
        if near.all():
            near = d < d.max()
        halves = ((near, start), (~near, start + int(near.sum())))
        self.children[node] = tuple((self._build(some[side], order, at), d[side].min(), d[side].max()) for side, at in halves)
        return node

    def cosines(self, some: slice, q: np.ndarray, norm: float) -> np.ndarray:
        """Row by row, so that equal rows have equal cosines wherever they stand."""
        return (self.rows[some] * q).sum(1) / (self.norms[some] * norm)

    def search(self, own: int, query: np.ndarray, k: int, floor: float | None) -> list[tuple[float, int]]:
        """The k best (cosine, id) found among rows whose id isn't ``own``; none below ``floor``.

        A branch whose rows are at least ``low`` away is skipped if ``relax * low`` is above the k-th distance so far.
        """
        scaled = _scaled(query[None])[0]
        norm = np.sqrt((scaled * scaled).sum())
        q = scaled / norm
        best: list[tuple[float, int]] = []  # (cosine, -id), the worst first
        kth = -np.inf if floor is None else floor
        reach = _distance(kth)
        open_nodes = [(0.0, 0)]
        while open_nodes:
            low, node = heapq.heappop(open_nodes)
            if self.relax * low > reach:
                break
            if self.children[node]:
                away = float(np.sqrt(((self.vantage[node] - q) ** 2).sum()))
                for child, least, largest in self.children[node]:
                    bound = max(low, least - away, away - largest)
                    if self.relax * bound <= reach:
                        heapq.heappush(open_nodes, (bound, child))
                continue
            score, ids = self.cosines(self.span[node], scaled, norm), self.ids[self.span[node]]
            fits = np.flatnonzero((score >= kth) & (ids != own))
            for i in fits[np.lexsort((ids[fits], -score[fits]))][:k]:
                item = (float(score[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and best[0][0] > kth:
                kth = best[0][0]
                reach = _distance(kth)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _distance(cosine: float) -> float:
    """Of unit vectors, with room for what rounding does to differences of nearly equal ones."""
    return np.inf if cosine == -np.inf else max(0.0, 2 - 2 * cosine) ** 0.5 + 1e-7


def approximate_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, relax: float = 2.0, shard_rows: int = 8192) -> DataFrame:
    """Each query's k nearest rows found by cosine: query_id, rank, vec_id, score (in double precision, on the original vectors).

    ``is_query``: a condition on vec_id. Ties go to the smaller vec_id. Vectors that are null or zero or hold null or non-finite
    components, and rows without vec_id, take no part, nor do pairs of different length. Rows that share the query's vec_id are its own;
    other repeated rows are separate candidates, and each repeated query row has ranks of its own. An empty table gives an
    empty result; extra columns are ignored.

    Unit vectors keep the order of cosines as distances, which obey the triangle inequality. Each shard of a region has a vantage-point
    tree. A region or branch is skipped if ``relax`` times the least distance that it can have is above the k-th distance found so far: at 1 only what
    can't hold a nearer row, so the search is exact; above 1 also what hardly can.
    """
    if relax < 1:
        raise ValueError("relax is 1 (exact) or more")

    def upper(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        low = np.maximum(0.0, np.sqrt(((centres - q) ** 2).sum(1)) - radii - 1e-7) * relax
        return 1 - low * low / 2

    zero = F.forall("embedding", lambda x: x == 0)
    clean = usable(vectors).where(~zero).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest(clean, is_query, k, shard_rows, lambda ids, rows: VantageTree(ids, rows, relax), _units, upper, np.float64, "double")
