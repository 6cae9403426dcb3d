"""Vectors and query sets dealt to tasks in blocks.

Every query meets every vector, block by block: vectors lie in blocks of about
`BLOCK` by a hash of their id, queries in blocks of about `QUERIES`, and a task takes
one of each. So memory is two blocks, and copies of one vector spread over all of them.
A search whose work in a block does not grow faster than its pairs takes blocks of `BYTES` instead (`by_size`):
the wider the blocks, the fewer copies of queries and vectors are sent and the fewer trees are made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import stored

BLOCK = 2048
QUERIES = 2048
BYTES = 16 << 20  # of a block's components
GROUPS = 4  # pairs of blocks per core at least, down to blocks of `BLOCK`
MATCH = "query_id long, vec_id long, score {}"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>): the different vectors of every id, all components finite.

    Rows with a null id, a null or empty vector, or null or non-finite components take no
    part. Equal rows count once; different vectors under one id all count.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(finite).distinct()


def matrix(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each dimension that occurs; only vectors of one dimension can be compared."""
    if not rows.num_rows:
        return []
    lists = rows.column("x").combine_chunks()
    ids = rows.column("vec_id").to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, start = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    out = []
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(ids[own], kind="stable")]
        out.append((ids[own], flat[start[own][:, None] + np.arange(size)]))
    return out


def by_count(vectors: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Numbers of blocks of vectors and of queries, of about `BLOCK` and `QUERIES`."""
    return max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))


def by_size(vectors: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Numbers of blocks of vectors and of queries, of at most about `BYTES`; more blocks of vectors where cores would be idle."""
    (n, wide), (_, asked_wide) = (df.agg(F.count("x"), F.coalesce(F.sum(F.size("x").cast("long")), F.lit(0))).first() for df in (vectors, queries))
    query_blocks = max(1, -(-asked_wide * 8 // BYTES))
    busy = -(-GROUPS * vectors.sparkSession.sparkContext.defaultParallelism // query_blocks)
    return max(1, -(-wide * 8 // BYTES), min(-(-n // BLOCK), busy)), query_blocks


def nearest(vectors: DataFrame, queries: DataFrame, k: int, kind: str,
            search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
            dealt: Callable[[DataFrame, DataFrame], tuple[int, int]] = by_count) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) per query over all blocks; ties go to the smaller id.

    search(query ids, query vectors, ids, vectors, k) gives the matches of one block as
    (query ids, ids, scores), a query's own id left out.
    """
    blocks, query_blocks = dealt(vectors, queries)
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    here = vectors.withColumn("block", at(blocks)).withColumn("queries", every(query_blocks))
    asked = queries.withColumn("queries", at(query_blocks)).withColumn("block", every(blocks))
    schema = MATCH.format(kind)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        own = {x.shape[1]: (ids, x) for ids, x in matrix(left)}
        for query_ids, q in matrix(right):
            if q.shape[1] in own:
                parts.append(search(query_ids, q, *own[q.shape[1]], k))
        q, v, s = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()),
                         "score": pa.array(s, pa.float64() if kind == "double" else pa.int64())})

    keys = ["block", "queries"]
    found = here.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(match, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_set(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0)


def prepared(vectors: DataFrame, label: str) -> DataFrame:
    return stored(vectors, label)
