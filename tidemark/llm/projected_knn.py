"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Inner product becomes a distance: with M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and q -> (q, 0) order by distance
as by inner product. Points are projected by `dims` Gaussian (2-stable) directions; for a pair at distance s the squared
projected distance is s^2 times a chi-square of `dims` degrees of freedom. The projected points lie in a kd-tree: its upper levels are cells of the
whole table, those below each block in a task. A query verifies true inner products in order of the projected distance r,
and stops when r^2 / d^2 (d: its kth best distance so far) reaches the chi-square's quantile `sure`: a point beyond r that is
nearer than d then has a chance below 1 - sure. Cells whose box lies beyond that r are not opened.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.knn import distinct_best, search, usable

ship(__name__)

DIMS = 24  # even
SURE = 0.92
LEAF = 64
STEP = 128  # points verified between tests


def chi_square(x: float, dims: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def quantile(p: float, dims: int) -> float:
    low, high = 0.0, 10.0 * dims + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kd-tree leaves: an order of the points, each leaf's start in it (and the end), and its box's lower and upper corners."""
    order, starts = np.arange(len(points)), []
    stack = [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        part = order[a:b]
        own = points[part]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        mid = (b - a) // 2
        order[a:b] = part[np.argpartition(own[:, axis], mid)]
        stack += [(a + mid, b), (a, a + mid)]
    starts = np.array(sorted(starts))
    low = np.minimum.reduceat(points[order], starts, axis=0)
    high = np.maximum.reduceat(points[order], starts, axis=0)
    return order, np.append(starts, len(points)), low, high


class ProjectedCells:
    """Cells of a kd-tree over projected points; an extent is a box."""

    def __init__(self, norm2: float, dims: int, sure: float, seed: int):
        self.norm2, self.dims, self.seed, self.stop = norm2, dims, seed, quantile(sure, dims)

    def project(self, data: np.ndarray, queries: bool = False) -> np.ndarray:
        directions = np.random.default_rng([self.seed, data.shape[1]]).standard_normal((data.shape[1] + 1, self.dims))
        extra = np.zeros(len(data)) if queries else np.sqrt(np.maximum(self.norm2 - (data * data).sum(axis=1), 0.0))
        return np.column_stack([data, extra]) @ directions

    def limit(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Squared projected distances from which on a query stops, by its kth score."""
        return self.stop * np.maximum((queries * queries).sum(axis=1) + self.norm2 - 2 * kth, 0.0)

    def fit(self, sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
        """Nodes (axis, cut, below, above): a child is another node, or -1 - cell."""
        points, nodes, made = self.project(sample), [], 0

        def grow(rows: np.ndarray, cells: int) -> int:
            nonlocal made
            if cells < 2 or len(rows) < 2:
                made += 1
                return -made
            axis = int(np.argmax(points[rows].max(axis=0) - points[rows].min(axis=0)))
            below = cells // 2
            cut = float(np.partition(points[rows, axis], len(rows) * below // cells)[len(rows) * below // cells])
            at = len(nodes)
            nodes.append((axis, cut, 0, 0))
            left = points[rows, axis] < cut
            nodes[at] = (axis, cut, grow(rows[left], below), grow(rows[~left], cells - below))
            return at

        grow(np.arange(len(points)), cells)
        return nodes

    def assign(self, model: list[tuple[int, float, int, int]], data: np.ndarray) -> np.ndarray:
        points, at = self.project(data), np.zeros(len(data), dtype=np.int64)
        if not model:
            return at
        axis, cut, below, above = (np.array(x) for x in zip(*model, strict=True))
        inside = np.arange(len(data))
        while len(inside):
            node = at[inside]
            at[inside] = np.where(points[inside, axis[node]] < cut[node], below[node], above[node])
            inside = inside[at[inside] >= 0]
        return -1 - at

    def extent(self, model: object, cell: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = self.project(data)
        return points.min(axis=0), points.max(axis=0)

    def worth(self, model: object, cells: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        limit, out = self.limit(queries, kth), np.empty((len(queries), len(cells)), dtype=bool)
        at = self.project(queries, queries=True)
        for i, x in enumerate(at):
            gap = np.maximum(np.maximum(low - x, x - high), 0.0)
            out[i] = (gap * gap).sum(axis=1) < limit[i]
        return out

    def verified(self, ids: np.ndarray, data: np.ndarray, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As search, and how many inner products were computed."""
        points, asked = self.project(data), self.project(queries, queries=True)
        order, cuts, low, high = leaves(points)
        points, data, ids = points[order], data[order], ids[order]
        repeated = len(np.unique(ids)) < len(ids)
        rows, found, values, count = [], [], [], 0
        size2 = (queries * queries).sum(axis=1)
        for i, (q, at) in enumerate(zip(queries, asked, strict=True)):
            stop = float(self.limit(queries[i : i + 1], kth[i : i + 1])[0])
            gap = np.maximum(np.maximum(low - at, at - high), 0.0)
            opened = np.flatnonzero((gap * gap).sum(axis=1) < stop)
            near = np.arange(len(ids)) if len(opened) == len(low) else np.concatenate([np.arange(cuts[c], cuts[c + 1]) for c in opened]) if len(opened) else np.empty(0, np.int64)
            far = points[near] - at
            far = np.einsum("ij,ij->i", far, far)
            some = np.flatnonzero(far < stop)
            some = some[np.argsort(far[some], kind="stable")]
            near, far = near[some], far[some]
            spot, step = 0, STEP
            best, scores = np.empty(0, np.int64), np.empty(0)
            while spot < len(near) and far[spot] < stop:
                take = near[spot : spot + step]
                count += len(take)
                take = take[ids[take] != own[i]]
                both, both_scores = np.concatenate([best, take]), np.concatenate([scores, data[take] @ q])
                if repeated:
                    top = distinct_best(ids[both], both_scores, k)
                else:
                    top = np.lexsort((ids[both], -both_scores))[:k]
                best, scores = both[top], both_scores[top]
                if len(best) == k:
                    stop = min(stop, self.stop * max(size2[i] + self.norm2 - 2 * scores[-1], 0.0))
                spot += step
            # The score that is returned is summed in one order for every pair, whatever else lay in its block.
            best = best[scores >= kth[i] - 1e-9 * (1 + abs(kth[i]))] if np.isfinite(kth[i]) else best
            rows.append(np.full(len(best), i))
            found.append(ids[best])
            values.append(np.array([math.fsum(q * data[b]) for b in best]))
        return np.concatenate(rows), np.concatenate(found), np.concatenate(values), count

    def search(self, ids, data, own, queries, kth, k):
        return self.verified(ids, data, own, queries, kth, k)[:3]


def nearest_projected(vectors: DataFrame, asked: Column, k: int = 20, dims: int = DIMS, sure: float = SURE, seed: int = 7) -> DataFrame:
    """The k candidates of largest inner product found for each query: query_id, rank (from 1), vec_id, score (double).

    vectors: vec_id, embedding; other columns are not read. asked (over vec_id): the queries; candidates: every other row. Vectors null, empty, zero or
    with null or non-finite components take no part, nor does a null vec_id. Vectors of equal vec_id are one
    candidate, with their best score. Ties go to the smaller vec_id. Fewer candidates than k give them all. Every row is indexed; the kd-tree's upper
    cuts are fitted on a sample of at most knn.SAMPLE rows, the largest norm and the boxes on all rows.
    """
    rows = usable(vectors, lambda x: x, zero=False)
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    return search(rows, asked, k, ProjectedCells(norm2 * (1 + 1e-12), dims, sure, seed), "double")
