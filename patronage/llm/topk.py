"""Exact top-k inner products by dual-tree search over cover trees.

Queries and vectors of a block each form a cover tree: a node has a centre, its children's
centres lie further apart than a scale that shrinks by `BASE` per level, and a covering radius bounds the
distance to every point below it. The product of any pair below a query node
and a vector node is at most <q, p> + r_q |p| + r_p |q| + r_q r_p; a pair of nodes goes unseen when that is less
than the worst k-th score in the query node; at a leaf of queries each of them has its own bound, with r_q = 0. Ties are kept, so ids decide them exactly.

Every query first sees the node that promises most, so bounds are there before nodes are compared. Points that lie
too far apart for their number are not split to the last: a node has `CHILDREN` children at most and a leaf
`LEAF` points, and what most queries of a leaf must see is seen in one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import give_back
from patronage.llm.vectors import by_size, nearest, prepared, query_set, valid

BASE = 1.3
LEAF = 256
CHILDREN = 64
AT_ONCE = 4096  # vectors of a product
ROWS = 1024  # queries of a product
FIRST = 256  # vectors that a query without a bound sees in one product
NONE = np.iinfo(np.int64).min
EXACT = 2.0**53
NARROW = 2.0**24


@dataclass
class Node:
    centre: np.ndarray
    length: float
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None, scale: float | None = None) -> Node:
    """The tree over the rows of x; every point lies in one leaf. A leaf has at most `LEAF` points, or is of one
    place, or of points that `CHILDREN` centres hardly bring closer together."""
    points = np.arange(len(x)) if points is None else points
    centre = int(points[0]) if centre is None else centre
    own = x[points]
    distance = np.linalg.norm(own - x[centre], axis=1)
    radius = float(distance.max()) * (1 + 1e-9)
    node = Node(x[centre], float(np.linalg.norm(x[centre])), radius, points)
    if len(points) <= LEAF or radius == 0:
        return node
    scale = min(radius, scale if scale is not None else radius) / BASE
    most = min(CHILDREN, len(points) // (LEAF // 4))
    squares = np.einsum("ij,ij->i", own, own)
    nearest, owner, centres = distance**2, np.zeros(len(points), np.int64), [centre]
    while len(centres) < most:  # further centres, each the point furthest from all before it, until the scale covers all
        far = int(nearest.argmax())
        if nearest[far] <= scale**2:
            break
        d = squares + squares[far] - 2 * (own @ own[far])  # only deals points out; radii are taken from differences
        d[far] = -np.inf
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(centres)
        centres.append(int(points[far]))
    sizes = np.bincount(owner, minlength=len(centres))
    if len(centres) == most and sizes.max() > 0.75 * len(points) and distance[owner == sizes.argmax()].max() > 0.9 * radius:
        return node
    node.children = [cover_tree(x, points[owner == i], c, scale) for i, c in enumerate(centres)]
    return node


class Best:
    """The k best scores of every query so far, and the rows of the vectors that have them; -1 for none."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.query_ids, self.x, self.ids = queries, query_ids, vectors, ids
        self.lengths = np.linalg.norm(queries, axis=1)
        self.scores, self.found = np.full((len(queries), k), NONE), np.full((len(queries), k), -1)
        # products and sums of integers below 2**53 are exact in doubles, those below 2**24 in floats
        widest = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * queries.shape[1]
        self.whole = None if widest < EXACT else [np.array([[int(v) for v in row] for row in m], dtype=object) for m in (queries, vectors)]
        self.short = [m.astype(np.float32) if widest < NARROW else m for m in (queries, vectors)]

    def products(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        if self.whole is None:
            return self.short[0][rows] @ self.short[1][points].T
        exact = self.whole[0][rows].dot(self.whole[1][points].T)
        return np.clip(exact, NONE + 1, -(NONE + 1)).astype(np.int64)  # as far as longs reach

    def see(self, rows: np.ndarray, points: np.ndarray) -> None:
        """All pairs of `rows` and `points`; a pair may be seen again."""
        for at in range(0, len(rows), ROWS):
            some, seen = rows[at:at + ROWS], 0
            while seen < len(points):
                size = FIRST if (self.scores[some, -1] == NONE).any() else AT_ONCE
                self._see(some, points[seen:seen + size])
                seen += size

    def _see(self, rows: np.ndarray, points: np.ndarray) -> None:
        k = self.scores.shape[1]
        scores = self.products(rows, points)
        low = self.scores[rows, -1].astype(scores.dtype)
        new = np.flatnonzero(self.scores[rows, -1] == NONE)
        if len(new) and len(points) > k:
            others = np.where(self.query_ids[rows[new]][:, None] == self.ids[points][None, :], scores.dtype.type(NONE), scores[new])
            low[new] = np.partition(others, -k, axis=1)[:, -k]
        r, c = np.divmod(np.flatnonzero(scores >= low[:, None]), len(points))
        s, p = scores[r, c].astype(np.int64), points[c]
        worst, last = self.scores[rows[r], -1], self.found[rows[r], -1]
        better = (s > worst) | (self.ids[p] <= self.ids[last])
        keep = better & (self.query_ids[rows[r]] != self.ids[p])
        if not keep.any():
            return
        r, s, p = r[keep], s[keep], p[keep]
        old = np.unique(r)
        before = self.found[rows[old]].ravel()
        r = np.concatenate([np.repeat(old, k)[before >= 0], r])
        s = np.concatenate([self.scores[rows[old]].ravel()[before >= 0], s])
        p = np.concatenate([before[before >= 0], p])
        order = np.lexsort((p, self.ids[p], -s, r))
        r, s, p = r[order], s[order], p[order]
        once = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        r, s, p = r[once], s[once], p[once]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        first = nth < k
        self.scores[rows[r[first]], nth[first]], self.found[rows[r[first]], nth[first]] = s[first], p[first]

    def reach(self, rows: np.ndarray, nodes: list[Node]) -> np.ndarray:
        """For each query the most that a product with a point below each node can be."""
        centres, radii = np.stack([p.centre for p in nodes]), np.array([p.radius for p in nodes])
        lengths = self.lengths[rows][:, None]
        limit = self.q[rows] @ centres.T + lengths * radii
        limit = limit + 1e-9 * (1 + lengths * (np.array([p.length for p in nodes]) + radii))
        return np.maximum(limit, float(NONE))  # as products are no less

    def worst(self, rows: np.ndarray) -> float:
        return float(self.scores[rows, -1].min())


def _bounds(q: Node, nodes: list[Node]) -> np.ndarray:
    centres = np.stack([p.centre for p in nodes])
    lengths, radii = np.array([p.length for p in nodes]), np.array([p.radius for p in nodes])
    slack = q.radius * lengths + radii * q.length + q.radius * radii
    return np.maximum(centres @ q.centre + slack + 1e-9 * (1 + lengths * q.length + slack), float(NONE))


def dual_search(q: Node, nodes: list[Node], best: Best) -> None:
    """All pairs below `q` and `nodes` that may still count."""
    first = [c for n in nodes for c in (n.children or [n])]
    for at in range(0, len(q.points) if len(first) > 1 else 0, AT_ONCE):
        rows = q.points[at:at + AT_ONCE]
        promise = best.reach(rows, first).argmax(axis=1)
        for n in np.unique(promise):
            best.see(rows[promise == n], first[n].points)
    _descend(q, nodes, best)


def _descend(q: Node, nodes: list[Node], best: Best) -> None:
    bounds = _bounds(q, nodes)
    keep = np.flatnonzero(bounds >= best.worst(q.points))
    kept = [nodes[i] for i in keep[np.argsort(-bounds[keep], kind="stable")]]
    if not kept:
        return
    if q.children:
        below = [c for n in kept for c in (n.children if n.radius > q.radius and n.children else [n])]
        for child in q.children:
            _descend(child, below, best)
        return
    waiting: list[np.ndarray] = []
    _look(q.points, q.points, kept, best, waiting)
    if waiting:
        best.see(q.points, np.concatenate(waiting))


def _look(leaf: np.ndarray, rows: np.ndarray, nodes: list[Node], best: Best, waiting: list[np.ndarray]) -> None:
    """What some rows of a leaf of queries must see below `nodes`; points that most of the leaf must see gather in `waiting`."""
    reach = best.reach(rows, nodes)
    wanted = reach >= best.scores[rows, -1][:, None]
    counts = wanted.sum(axis=0)
    for i in np.argsort(-reach.max(axis=0), kind="stable"):
        if not counts[i]:
            continue
        if nodes[i].children:
            _look(leaf, rows if 2 * counts[i] >= len(rows) else rows[wanted[:, i]], nodes[i].children, best, waiting)
        elif 2 * counts[i] >= len(leaf):
            waiting.append(nodes[i].points)
            if sum(map(len, waiting)) >= AT_ONCE:
                best.see(leaf, np.concatenate(waiting))
                waiting.clear()
        else:
            best.see(rows[wanted[:, i]], nodes[i].points)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    give_back()  # what the blocks before left
    best = Best(queries, query_ids, vectors, ids, k)
    dual_search(cover_tree(queries), [cover_tree(vectors)], best)
    row, at = np.nonzero(best.found >= 0)
    return query_ids[row], ids[best.found[row, at]], best.scores[row, at]


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, embedding) whose id is divisible by `every`.

    Components are taken as floor(factor * x); score is the integer inner product, highest first, ties to the
    smaller id; a query with fewer than k other vectors gets them all. Vectors of another dimension
    are no candidates. Components and scores beyond longs take the nearest long.

    Defined cases: null and empty vectors and those with null or non-finite components take
    no part; zero vectors do; a null id takes no part; repeated rows count once; an empty
    table gives no rows; other columns are not looked at.
    """
    scaled = F.transform("x", lambda v: F.floor(v * F.lit(float(factor))).cast("long").cast("double"))
    usable = prepared(valid(vectors).withColumn("x", scaled), "scaled-vectors")
    return nearest(usable, query_set(usable, every), k, "long", search, by_size)


SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""
