"""SimHash near-duplicates, found through pivot distance tables.

A fingerprint's distances to many reference fingerprints (pivots) are computed
once. By the triangle inequality two fingerprints at most `bits` apart differ by
at most `bits` in their distance to every pivot, so pairs with a larger
coordinate difference are discarded unseen; the others are verified bit by bit.

Spark deals the pairs out: fingerprints `bits` or fewer apart agree in one of
`bits` + 1 bands, so only fingerprints with a band in common meet in a task.
Documents with one fingerprint count once. A band value with more than `CHUNK`
fingerprints is dealt to chunks, and tasks take pairs of chunks, so no task holds
an unbounded group. A task reports a spanning forest of what it finds linked,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import per_batch, stored, texts_of
from patronage.llm.graph import components

WORDS = 3
BITS = 3
SEED = 42
PIVOTS = 16
PIVOT_SAMPLE = 512
CHUNK = 2048
BATCH = 500
WIDTH = 64


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """Hashes of a text's word shingles, repeats included; no words: none."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return []
    whole = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(whole, SEED)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return [digest(whole[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]


def majority(hashes: list[int]) -> int:
    """The bits that most hashes have, as a signed long; no hashes: 0."""
    count = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at:at + 65_536], dtype="<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, repeats included, as a signed long; no words: 0."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row of `docs`, over whole texts; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(BATCH, batches):
            fps = pa.array([fingerprint(t, words) for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def pivots(distinct: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[int]:
    """Reference fingerprints far from each other, out of a bounded sample; any choice gives the same links."""
    pool = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    if not pool:
        return [0]
    values = np.array(pool, dtype=np.int64).view(np.uint64)
    chosen, gap = [0], np.bitwise_count(values ^ values[0]).astype(int)
    while len(chosen) < min(n, len(pool)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.bitwise_count(values ^ values[chosen[-1]]))
    return [pool[i] for i in chosen]


def _distances(fp: Column, references: list[int]) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in references])


def near_pairs(key: np.ndarray, side: np.ndarray, fps: np.ndarray, table: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal key at most `bits` apart; rows come sorted by key, then side.

    Rows of the kinds 0 and 1 meet across only, rows of kind 2 (a chunk with itself) all meet.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))  # end of each row's group
    left, step = np.arange(len(key)), 1
    while len(left := left[left + step < last[left]]):
        a, b = left, left + step
        meet = (side[a] == 2) | (side[a] != side[b])
        a, b = a[meet], b[meet]
        for p in range(table.shape[1]):  # discard by the largest coordinate difference
            close = np.abs(table[a, p] - table[b, p]) <= bits
            a, b = a[close], b[close]
            if not len(a):
                break
        same = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        if same.any():
            yield a[same], b[same]
        step += 1


class Forest:
    """Union-find over fingerprints; tells which links join what was apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(distinct: DataFrame, bits: int = BITS, chunk: int = CHUNK, n_pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span the groups linked at `bits` or fewer differing bits."""
    references = pivots(distinct, n_pivots)
    bands = bits + 1
    edges = [round(i * WIDTH / bands) for i in range(bands + 1)]
    fp = F.col("fp")
    values = F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftright(F.shiftleft(fp, WIDTH - high), WIDTH - high + low).alias("value"))
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ])
    banded = stored(
        distinct.select("fp", _distances(fp, references).alias("table"), F.explode(values).alias("at"))
        .select("fp", "table", F.col("at.band").alias("band"), F.col("at.value").alias("value")), "bands")
    sizes = stored(banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("band", "value", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "band-sizes")
    own = F.pmod(F.xxhash64("fp", "band"), F.col("chunks")).cast("int")
    dealt = (
        banded.join(sizes, ["band", "value"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "table", F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
                F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            fps = rows.column("fp").to_numpy()
            flat = rows.column("table").combine_chunks().flatten().to_numpy()
            table = flat.reshape(len(fps), -1).astype(np.int16)
            forest, out = Forest(), []
            for a, b in near_pairs(rows.column("key").to_numpy(), rows.column("side").to_numpy(), fps.view(np.uint64), table, bits):
                out += [(x, y) for x, y in zip(fps[a].tolist(), fps[b].tolist()) if forest.join(x, y)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for batch in batches:  # a key's rows stay together: the last key waits for the next batch
            held.append(batch)
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield found(rows.slice(0, cut).combine_chunks())
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return dealt.repartition("key").sortWithinPartitions("key", "side").mapInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id of all documents that can be reached over links of
    at most `bits` differing bits.

    Defined cases: null and empty texts, and texts of white space, have the fingerprint zero
    and are linked like any other; texts shorter than a shingle count as one shingle;
    a null doc_id never names a component (a component of null ids alone has a null id);
    repeated rows come back each; an empty table gives no rows; other columns are not looked at.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, bits)).withColumnRenamed("node", "fp")
    grouped = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(grouped.join(least, "root").select("fp", "component_id"), "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
