"""Approximate nearest neighbours by collision counting.

Each vector, scaled to length one, is projected on `PROJECTIONS` random directions,
and every projection is a sorted array. A query opens a window around its own value in
each array; a vector that lies in at least `THRESHOLD` of the windows collides often enough and is
verified by its exact cosine. If fewer than `VERIFY` of the vectors collide, the windows
widen (virtual rehashing: the same arrays serve every width) until enough do or
the windows hold everything.

Every vector is indexed, in the block it is dealt to; the directions do not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.vectors import nearest, prepared, query_set, valid

PROJECTIONS = 96
THRESHOLD = 0.6  # share of the windows a vector must lie in
VERIFY = 0.25  # share of a block that is verified at least, besides k
FIRST_WIDTH, WIDEN = 1.0, 1.25  # in units of a projection's spread over vectors of length one
AT_ONCE = 256  # queries whose windows are open together
SEED = 20_240_229


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, unit: np.ndarray, projections: int = PROJECTIONS):
        self.n = len(unit)
        self.directions = np.random.default_rng(SEED).standard_normal((projections, unit.shape[1]))
        values = unit @ self.directions.T
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.reach = float(np.abs(values).max(initial=0.0))

    def candidates(self, unit_queries: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
        """Per query the positions of the vectors that collide with it often enough, at the first width that gives `wanted`.

        Windows are found for all open queries together; a query counts only what each widening adds.
        """
        centres = unit_queries @ self.directions.T
        need = int(np.ceil(THRESHOLD * centres.shape[1]))
        end = self.reach + np.abs(centres).max(axis=1, initial=0.0)
        counts: dict[int, np.ndarray] = {}
        low = high = np.zeros(centres.shape, np.int64)
        open_, width = np.arange(len(centres)), FIRST_WIDTH
        while len(open_):
            left, right = (
                np.stack([np.searchsorted(v, c, side) for v, c in zip(self.values, (centres[open_] + shift).T)], axis=1)
                for shift, side in ((-width, "left"), (width, "right"))
            )
            more = []
            for n, query in enumerate(open_.tolist()):
                windows = zip(self.order, left[n].tolist(), right[n].tolist())
                if query in counts:
                    old = zip(windows, low[n].tolist(), high[n].tolist())
                    parts = [part for (o, a, b), c, d in old for part in (o[a:c], o[d:b])]
                else:
                    parts = [o[a:b] for o, a, b in windows]
                count = np.bincount(np.concatenate(parts), minlength=self.n)
                count += counts.pop(query, 0)
                found = np.flatnonzero(count >= need)
                if len(found) >= wanted or width > end[query]:
                    yield query, found
                else:
                    counts[query] = count
                    more.append(n)
            open_, low, high = open_[more], left[more], right[more]
            width *= WIDEN


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(vectors, axis=1)
    index = CollisionIndex(vectors / lengths[:, None])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    wanted = k + int(np.unique(ids, return_counts=True)[1].max(initial=1)) + int(VERIFY * len(ids))  # own vectors do not count
    sizes = np.linalg.norm(queries, axis=1)
    for at in range(0, len(queries), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        for n, found in index.candidates(queries[part] / sizes[part, None], wanted):
            query_id, q = query_ids[at + n], queries[at + n]
            found = found[ids[found] != query_id]
            scores = (vectors[found] @ q) / (lengths[found] * sizes[at + n])
            best = np.lexsort((ids[found], -scores))[:k]
            out.append((np.full(len(best), query_id), ids[found][best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, embedding) whose id is divisible by `every`.

    score is the cosine in double precision, largest first, ties to the smaller id; a query with fewer
    than k other vectors gets them all. Vectors of another dimension are no candidates.

    Defined cases: null, empty and zero vectors and those with null or non-finite components
    take no part, as query or candidate; a null id takes no part; repeated rows count once; an
    empty table gives no rows; other columns are not looked at.
    """
    usable = valid(vectors)
    largest = F.array_max(F.transform("x", F.abs))
    # scaled by the largest component where squares would leave the range of doubles
    extreme = (largest > 1e150) | (largest < 1e-140)
    usable = usable.where(largest > 0).withColumn("x", F.when(extreme, F.transform("x", lambda v: v / largest)).otherwise(F.col("x")))
    usable = prepared(usable, "vectors")
    return nearest(usable, query_set(usable, every), k, "double", search)
