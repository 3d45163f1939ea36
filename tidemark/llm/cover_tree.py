"""Exact top-k search with two cover trees.

A node covers its points within its radius; its children's centres are a net: taken farthest first, so they lie at least as far
apart as the radius that they cover, and every point belongs to the nearest. The upper level of the data's tree is made of cells of the
whole table (its net is taken from a sample, the radii from all rows), the levels below of each block in a task; queries have a tree of their own.
Pairs of nodes are visited together, those with the highest bound first. No score of a pair of nodes (q, r) exceeds
q.r + |q| R_r + |r| R_q + R_q R_r with the covering radii R; the pair goes if that is below the worst kth score of the query node's points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.knn import distinct_best, search, usable

ship(__name__)

LEAF = 256  # points of a node that is not split: they are scored at once
FANOUT = 32  # children of a node
LOWEST = -(1 << 63)  # below all scores
LARGEST = 1e150  # of a quantised component: squares of more are no doubles


def net(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of centres, each point's centre): farthest first from the first point on, `most` at most, none of them equal."""
    def away(at: int) -> np.ndarray:
        d = points - points[at]
        return np.einsum("ij,ij->i", d, d)

    centres, near = [0], away(0)
    owner = np.zeros(len(points), dtype=np.int64)
    while len(centres) < most:
        at = int(near.argmax())
        if near[at] <= 0:
            break
        new = away(at)
        closer = new < near
        owner[closer], near[closer] = len(centres), new[closer]
        centres.append(at)
    return np.array(centres), owner


class Node:
    __slots__ = ("centre", "radius", "rows", "children", "norm")

    def __init__(self, points: np.ndarray, at: int, rows: np.ndarray):
        d = points[rows] - points[at]
        self.centre, self.rows, self.children = points[at], rows, []
        self.radius = float(np.sqrt(np.einsum("ij,ij->i", d, d).max()))
        self.norm = float(np.sqrt(self.centre @ self.centre))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    root = Node(points, 0, np.arange(len(points)))
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node.rows) > leaf and node.radius > 0:
            centres, owner = net(points[node.rows], FANOUT)
            node.children = [Node(points, int(node.rows[c]), node.rows[owner == i]) for i, c in enumerate(centres)]
            stack.extend(node.children)
    return root


def _wrapped(x: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, modulo 2^64."""
    x = np.fmod(x, 2.0**64)
    return np.where(x >= 2.0**63, x - 2.0**64, np.where(x < -(2.0**63), x + 2.0**64, x)).astype(np.int64)


def _fitting(scores: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """scores: x times y modulo 2^64, right where the product surely fits; the others but `own` anew by Python's integers."""
    near, slack = x @ y.T, (np.abs(x) @ np.abs(y).T) * x.shape[1] * 2.0**-50 + 1
    for i, j in np.argwhere(~own & ~(np.abs(near) + slack < 2.0**63)):
        score = sum(int(p) * int(q) for p, q in zip(x[i], y[j]))
        if not LOWEST < score < -LOWEST:
            raise OverflowError(f"the score {score} of two vectors does not fit a long")
        scores[i, j] = score
    return scores


def dual_search(ids: np.ndarray, data: np.ndarray, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vec_id, score) of each query's k best that reach kth, and how many pairs were scored; integer data, exact."""
    top = np.full((len(own), k), LOWEST)
    top_ids = np.full((len(own), k), np.iinfo(np.int64).max)
    # A double below the kth score: no score that reaches it is lost to rounding.
    floor = np.where(np.isfinite(kth), kth - np.abs(kth) * 2.0**-50, -np.inf)
    most = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * data.shape[1]
    a, b = (data, queries) if most < 2.0**53 else (_wrapped(data), _wrapped(queries))
    repeated = len(np.unique(ids)) < len(ids)
    scored = 0

    lengths = np.sqrt((queries * queries).sum(axis=1))

    def base(q: Node, r: Node) -> None:
        """Two leaves: each query on its own may still leave out the points."""
        nonlocal scored
        up = queries[q.rows] @ r.centre + lengths[q.rows] * (r.radius + (r.norm + r.radius) * 1e-9) + 1e-6
        rows = q.rows[up >= np.maximum(top[q.rows, k - 1].astype(float), floor[q.rows])]
        if not len(rows):
            return
        scored += len(rows) * len(r.rows)
        scores = (b[rows] @ a[r.rows].T).astype(np.int64)
        mine = own[rows][:, None] == ids[r.rows][None]
        if most >= 2.0**62:
            scores = _fitting(scores, mine, queries[rows], data[r.rows])
        scores[mine] = LOWEST
        worst = top[rows, k - 1]
        reach = (scores >= worst[:, None]) & (scores >= floor[rows][:, None]) & ~mine
        for i in np.flatnonzero(reach.any(axis=1)):
            row, some = rows[i], np.flatnonzero(reach[i])
            if len(some) > 4 * k and not repeated:
                some = some[scores[i][some] >= np.partition(scores[i][some], -k)[-k]]
            both = np.concatenate([top[row][top[row] > LOWEST], scores[i][some]])
            both_ids = np.concatenate([top_ids[row][top[row] > LOWEST], ids[r.rows[some]]])
            best = distinct_best(both_ids, both, k) if repeated else np.lexsort((both_ids, ~both))[:k]
            top[row, : len(best)], top_ids[row, : len(best)] = both[best], both_ids[best]

    def bounds(q: Node, others: list[Node]) -> np.ndarray:
        centres = np.array([r.centre for r in others])
        radii, norms = np.array([r.radius for r in others]), np.array([r.norm for r in others])
        slack = (q.norm + q.radius) * (norms + radii) * 1e-9 + 1e-6  # rounding goes with the lengths, whatever the score
        return centres @ q.centre + q.norm * radii + norms * q.radius + q.radius * radii + slack

    first, other = cover_tree(queries), cover_tree(data)
    stack = [(first, other, float(bounds(first, [other])[0]))]
    while stack:
        q, r, bound = stack.pop()
        worst = np.maximum(top[q.rows, k - 1].astype(float), floor[q.rows]).min()  # the query group's worst kth score
        if worst > LOWEST and bound < worst:
            continue
        if not q.children and not r.children:
            base(q, r)
        elif r.children and (not q.children or r.radius >= q.radius):
            up = bounds(q, r.children)
            stack.extend((q, r.children[i], up[i]) for i in np.argsort(up, kind="stable"))
        else:
            stack.extend((c, r, float(bounds(c, [r])[0])) for c in q.children)
    some = top > LOWEST
    return np.nonzero(some)[0], top_ids[some], top[some], scored


class CoverCells:
    """Cells around the centres of a net; an extent is a covering radius."""

    def fit(self, sample: np.ndarray, cells: int) -> np.ndarray:
        return sample[net(sample, cells)[0]]

    def assign(self, model: np.ndarray, data: np.ndarray) -> np.ndarray:
        # Nearest of the centres, up to rounding; the radii come from the cell that is given here.
        scale = max(float(np.abs(model).max(initial=0)), float(np.abs(data).max(initial=0)), 1.0)
        x, c = data / scale, model / scale
        return ((c * c).sum(axis=1)[None] - 2 * (x @ c.T)).argmin(axis=1)

    def extent(self, model: np.ndarray, cell: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = data - model[cell]
        return np.zeros(1), np.sqrt(np.einsum("ij,ij->i", d, d).max(keepdims=True))

    def worth(self, model: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        norms, radii = np.sqrt((queries * queries).sum(axis=1))[:, None], high[:, 0][None]
        slack = norms * (np.sqrt((model[cells] ** 2).sum(axis=1))[None] + radii) * 1e-9 + 1e-6
        return queries @ model[cells].T + norms * radii + slack >= kth[:, None]

    def search(self, ids, data, own, queries, kth, k):
        return dual_search(ids, data, own, queries, kth, k)[:3]


def exact_top_k(vectors: DataFrame, asked: Column, k: int = 20) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank (from 1), vec_id, score (long).

    A component x becomes floor(64 * x), x as double. vectors: vec_id, embedding; asked (over vec_id): the queries;
    candidates: every row but the query's own. Vectors null, empty, or with null or non-finite components take no part,
    nor a null vec_id; other columns are not read. Zero vectors do. Ties go to the smaller vec_id. Vectors of equal vec_id are one candidate, with
    their best score. A score that does not fit a long stops the job, as does a component that becomes LARGEST or more.
    """
    too_large = F.raise_error(F.lit("a component is too large for scores that fit a long")).cast("double")

    def quantised(x: Column) -> Column:  # from 2^53 on, doubles are whole
        whole = F.when(F.abs(x) < 2.0**53, F.floor(x * 64.0).cast("double")).when(F.abs(x) < LARGEST / 64, x * 64.0).otherwise(too_large)
        return F.when(F.abs(x) < float("inf"), whole)

    rows = usable(vectors, quantised, zero=True)
    return search(rows, asked, k, CoverCells(), "long")
