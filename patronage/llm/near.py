"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

No number of fingerprint bits is sure to admit a similarity (at 0.8 about ten of 64 bits differ, give or
take three, and a limit that admits nearly all of them meets nearly every pair). So SimHash with its bands and
pivot tables finds the closest copies cheaply, and a prefix filter finds all others. Most documents are like no other, and go first:

1. Documents with one set of shingles count once. Of a set that is similar to another at most a fifth is its own. Shingles
   whose hash lies in the lowest `SIEVE` of the range meet; a set that alone holds more than a fifth of its size among them is out.
2. The others link where fingerprints a few bits apart belong to similar sets. That connects most of a large group.
3. All their shingles meet and are counted. Ordered by how many sets hold them, rarest first, two similar sets have their
   first common shingle among the first n - ceil(0.8 n) + 1 of either; those that a set holds alone need not be looked up. Sets
   of different groups meet by these and are compared whole in the task: by the two rarest first, which
   connects most that is left, then by all. A task reports a spanning forest of the links it finds, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm import simhash
from patronage.llm.common import fresh, give_back, per_batch, scratch, stored, texts_of
from patronage.llm.graph import components
from patronage.llm.lines import _by_key

WORDS = 5
OF, SHARE = 5, 4  # least Jaccard similarity: SHARE / OF
SIEVE = 0.35
CHUNK = 512
AT_ONCE = 4096  # rows of one shingle that are counted; one with more counts as this frequent
RAREST = 2  # shared shingles by which sets meet first
BLOCK = 128  # sets compared at once
FEW = 16  # pairs that are compared one by one


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of a text's word shingles."""
    return np.unique(np.array(simhash.shingle_hashes(text, words), dtype=np.uint64))


def similar(common, n, m):
    """Whether sets of n and m shingles with so many in common are similar enough."""
    return common * (OF + SHARE) >= SHARE * (n + m)


def _spare(n):
    """How many shingles of a set of n, a column, can be missing in a similar set."""
    return n - F.ceil(n * SHARE / OF)


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, row, whole, n, low) per row of `docs`: hashes of the row and of its set, size, and the lowest of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        top = np.uint64(int(SIEVE * 2 ** 64))
        for batch in per_batch(simhash.BATCH, batches):
            whole, n, low = [], [], []
            for text in texts_of(batch):
                own = shingles(text)
                whole.append(xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED) - (1 << 63))
                n.append(len(own))
                low.append(own[:np.searchsorted(own, top)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.list_(pa.int64()))],
                names=["doc_id", "row", "whole", "n", "low"])
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, row long, whole long, n long, low array<long>")


def _held_by_many(posted: DataFrame) -> DataFrame:
    """(key, whole, many) of the rows (key, whole) whose key comes more than once, and how often, up to `AT_ONCE`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in _by_key(batches, AT_ONCE):
            key, whole = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            many = np.full(len(key), AT_ONCE) if large else np.minimum(np.repeat(size, size), AT_ONCE)
            shared = many > 1
            yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(whole[shared]), pa.array(many[shared].astype(np.int32))], names=["key", "whole", "many"])
        give_back()

    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, whole long, many int")


def sieved(distinct: DataFrame) -> DataFrame:
    """(whole, row, n) of the sets that may be similar to another, by their lowest shingles."""
    met = _held_by_many(distinct.select(F.explode("low").alias("key"), "whole")).groupBy("whole").agg(F.count(F.lit(1)).alias("shared"))
    alone = F.size("low") - F.coalesce("shared", F.lit(0))
    return distinct.where("n > 0").join(met, "whole", "left").where(alone <= _spare(F.col("n"))).select("whole", "row", "n")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(whole, n, fp, set) of the sets `wanted` (whole, row, n): fingerprints and ascending shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(simhash.BATCH, batches):
            hashes = [simhash.shingle_hashes(t, WORDS) for t in texts_of(batch)]
            fps = [simhash.majority(h) for h in hashes]
            own = [np.unique(np.array(h, dtype=np.uint64)).view(np.int64) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["whole", "n", "fp", "set"])
        give_back()

    rows = wanted.withColumnRenamed("row", "own")
    texts = docs.select(F.col("text").cast("string").alias("text"), _row().alias("own")).join(rows, "own").dropDuplicates(["own"])
    return texts.select("whole", "n", "text").mapInArrow(run, "whole long, n long, fp long, set array<long>")


def verified(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) of sets that are similar enough, by their shingles."""
    left, right = (full.select(F.col("whole").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (v.values.to_numpy() for v in (x, y))
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def close_fingerprints(full: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets to verify: every set with the least one of its fingerprint, and those along links of fingerprints."""
    least = stored(full.groupBy("fp").agg(F.min("whole").alias("least")), "least-sets")
    same = full.join(least, "fp").where("whole <> least").select(F.col("least").alias("a"), F.col("whole").alias("b"))
    linked = simhash.links(least).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    ends = (least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x)) for x in "ab")
    for end, x in zip(ends, "ab"):
        linked = linked.join(end, f"fp_{x}")
    return same.unionByName(linked.select("a", "b"))


def shared_lists(full: DataFrame) -> DataFrame:
    """(whole, n, list): the shingles that other sets hold too, rarest first, of the sets that hold no more than a fifth alone."""
    met = _held_by_many(full.select(F.explode("set").alias("key"), "whole"))
    lists = met.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("list"))
    return lists.join(full.select("whole", "n"), "whole").where(F.col("n") - F.size("list") <= _spare(F.col("n"))).select("whole", "n", F.col("list.key").alias("list"))


def _compare(sets: list[np.ndarray], n: np.ndarray, root: list[int], side: np.ndarray, forest: simhash.Forest) -> Iterator[tuple[int, int]]:
    """Index pairs of similar sets that connect something: blocks of sets against blocks, few pairs one by one."""
    blocks = [range(i, min(i + BLOCK, len(sets))) for i in range(0, len(sets), BLOCK)]
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            if len(left) * len(right) <= FEW:
                for a in left:
                    for b in right:
                        if a < b and (side[a] == 2 or side[a] != side[b]) and forest.root(root[a]) != forest.root(root[b]) and similar(min(n[a], n[b]), n[a], n[b]):
                            if similar(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), n[a], n[b]) and forest.join(root[a], root[b]):
                                yield a, b
                continue
            if len({forest.root(root[a]) for a in (*left, *right)}) < 2:
                continue
            x, y = (_incidence([sets[a] for a in part], both) for part, both in ((p, np.unique(np.concatenate([sets[a] for a in (*left, *right)]))) for p in (left, right)))
            near = similar((x @ y.T).astype(np.int64), n[left.start:left.stop, None], n[None, right.start:right.stop])
            for a, b in zip(*(v.tolist() for v in np.nonzero(near))):
                a, b = a + left.start, b + right.start
                if a < b and (side[a] == 2 or side[a] != side[b]) and forest.join(root[a], root[b]):
                    yield a, b


def _incidence(sets: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(among)), np.float32)
    for i, s in enumerate(sets):
        out[i, np.searchsorted(among, s)] = 1
    return out


def candidates(lists: DataFrame, rooted: DataFrame, first: int | None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of similar sets of different roots that meet by the shared shingles of their prefixes, or the `first` of them."""
    rows = lists.join(rooted, "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    prefix = F.slice("list", 1, F.greatest(F.lit(0), _spare(F.col("n")) + 1 - (F.col("n") - F.size("list"))).cast("int"))
    prefix = F.slice(prefix, 1, first) if first else prefix
    posted = stored(rows.select("whole", "root", F.explode(prefix).alias("key")), "prefixes")
    sizes = (posted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("key", F.ceil(F.col("m") / chunk).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("whole"), F.col("chunks")).cast("int")
    dealt = stored(
        posted.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), "whole", "root",
                F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side")), "meetings")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = simhash.Forest()
        for rows, _ in _by_key(batches):
            key, whole, root, side, n = (rows.column(c).to_numpy() for c in ("meeting", "whole", "root", "side", "n"))
            held = rows.column("list")
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], len(key)]):
                names = root[a:b].tolist()
                if b - a < 2 or len({forest.root(r) for r in names}) < 2:
                    continue
                own = [np.sort(held[i].values.to_numpy()) for i in range(a, b)]
                found = list(_compare(own, n[a:b], names, side[a:b], forest))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([whole[a + i] for i, _ in found], pa.int64()), pa.array([whole[a + j] for _, j in found], pa.int64())], names=["a", "b"])
        give_back()

    meeting = dealt.join(lists, "whole").select("meeting", "whole", "root", "side", "n", "list")
    return meeting.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(search, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row, component) per row of `docs`: what is linked by a similarity of 0.8 or more has one component.

    row: hash of id and text. Defined cases: null and empty texts, and texts of white space, are copies of each other;
    a text shorter than a shingle is one shingle; texts of any length are compared whole; a null doc_id is no obstacle; repeated rows come
    back each; an empty table gives no rows; other columns are not looked at.
    """
    with scratch(docs.sparkSession):
        marked = stored(sets(docs), "shingled")
        distinct = marked.groupBy("whole").agg(F.min("n").alias("n"), F.min("row").alias("row"), F.first("low").alias("low"))
        wanted = stored(sieved(stored(distinct, "distinct-sets")), "sieved")
        full = stored(whole_sets(docs, wanted), "whole-sets")
        links = stored(verified(full, stored(close_fingerprints(full).distinct(), "close-fingerprints")), "close-links")
        lists = stored(shared_lists(full), "shared-lists")
        for first in (RAREST, None):
            roots = components(links).withColumnRenamed("node", "whole")
            links = links.unionByName(stored(candidates(lists, roots, first), "near-links"))
        roots = components(links).withColumnRenamed("node", "whole")
        return stored(marked.select("doc_id", "row", "whole").join(roots, "whole", "left").select("doc_id", "row", F.coalesce("root", "whole").alias("component")),
                      "near-copies", keep=True)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each group one row stays, that with the least doc_id, null coming last.

    Of rows with that id the first by a hash of id and text stays, and of equal rows one.
    """
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    own, nth = fresh(docs, "kept_row"), fresh(docs, "nth")
    first = near_copies(docs).groupBy("component").agg(F.min(at).alias("first")).select(F.col("first.row").alias(own))
    rows = docs.join(first, _row() == F.col(own), "left_semi")
    once = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    return rows.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(nth)
