"""Best-fit packing of documents into sequences of a fixed length.

Best-fit decreasing places items by length alone, so the plan of the whole
corpus follows from how many pieces there are of each length: a table of at most
`seq_len` rows, whatever the corpus. The driver packs that table; pieces are
numbered and placed by Spark.

1. Tasks encode whole texts, cut documents over `seq_len` into pieces and number
   their pieces per length; the piece table is written once.
2. Counts per task and length give every task its first number for each length.
3. `best_fit` places runs of equal pieces into runs of equal bins. A segment tree
   over remaining capacities finds the tightest open bin in O(log seq_len).
4. Each piece looks its number up among the runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import per_batch, per_worker, shared, stored, texts_of, vocabulary
from patronage.llm.encoding import Encoder

SEQ_LEN = 2048
BATCH = 500
REMEMBER = 600_000  # encoded pieces that a worker remembers; fewer take less memory and more time


class Capacities:
    """Segment tree over remaining capacities 0..top: which of them have an open bin."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            now = self.open[2 * at] or self.open[2 * at + 1]
            if self.open[at] == now:
                break
            self.open[at] = now

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need with an open bin."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:  # up to the first right sibling with an open bin, then down its left edge
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over `counts` (length -> pieces), exact.

    Bins with one remaining capacity are kept as ranges of bin numbers. The
    pieces of one length, numbered from 0, fill ranges in turn: the tightest bin
    stays the tightest until it holds no further piece of that length. Returns
    runs (length, first number, pieces, first bin, pieces per bin, offset). A
    range is halved in capacity or better whenever a run fills it, so there are at most
    O(seq_len * log seq_len) runs.
    """
    tree = Capacities(seq_len)
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs = []
    bins = 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            ranges.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        opened: list[tuple[int, int, int]] = []
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = seq_len
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = capacity // length
                first, n = ranges[capacity].pop()
                used = min(n, -(-left // each))
                if used < n:
                    ranges[capacity].append((first + used, n - used))
                n = used
                if not ranges[capacity]:
                    tree.set(capacity, False)
            full = min(n, left // each)
            if full:
                runs.append((length, number, full * each, first, each, seq_len - capacity))
                number, left = number + full * each, left - full * each
                opened.append((capacity - each * length, first, full))
            if full < n:  # the last bin takes what is left of this length
                runs.append((length, number, left, first + full, each, seq_len - capacity))
                opened.append((capacity - left * length, first + full, 1))
                left = 0
        for item in opened:
            put(*item)
    return runs


def pieces(docs: DataFrame, spec: str, seq_len: int = SEQ_LEN, end_id: int = 0, with_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, part, nth (number in its task and length), ids if asked."""
    sent = shared(docs.sparkSession, spec)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids binary" if with_ids else "")
    names = [f.strip().split()[0] for f in schema.split(",")]
    end = np.array([end_id], dtype="<u4").tobytes()
    name = zlib.crc32(spec.encode())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = per_worker(("encoder", name, remember), lambda: Encoder(sent.value, remember)), TaskContext.get().partitionId(), {}
        width = 4 * seq_len
        for batch in per_batch(BATCH, batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch))):
                ids += end
                for n, at in enumerate(range(0, len(ids), width)):
                    own = ids[at:at + width]
                    length = len(own) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc, n, at // 4, length, zlib.crc32(own), part, nth) + ((own,) if with_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = 0, with_ids: bool = False,
         remember: int = REMEMBER) -> DataFrame:
    """Pack every document of `docs` (doc_id, text; other columns are not looked at).

    tokenizer: path of a tokenizers file. end_id closes each document. Returns per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id (from 0), offset, and
    with `with_ids` the ids as little-endian unsigned 32-bit. remember: encoded pieces that a worker holds.

    Defined cases: null or empty text is the end id alone; a null doc_id is kept as
    null; repeated rows are packed once each; equal lengths are placed in the order
    of their numbers; an empty table gives no rows. Long texts are cut, never dropped.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary(tokenizer), seq_len, end_id, with_ids, remember), "pieces")
    per_task = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most seq_len rows
    runs = sorted(best_fit({r["length"]: r["n"] for r in totals}, seq_len))
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)
    sent = shared(spark, table)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = cut.join(first, ["part", "length"]).withColumn("number", F.col("first") + F.col("nth")).drop("part", "first", "nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        # one ascending key out of length and number: rank of the length, then the number
        lengths, rank = np.unique(runs[:, 0], return_inverse=True)
        top = int(runs[:, 1].max(initial=0) + runs[:, 2].max(initial=0)) + 1
        keys = rank.reshape(-1) * top + runs[:, 1]
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            length, number = get("length").to_numpy(), get("number").to_numpy()
            run = runs[np.searchsorted(keys, np.searchsorted(lengths, length) * top + number, "right") - 1]
            nth = number - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
            keep = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [get(n) for n in keep] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*keep, "sequence_id", "offset"],
            )

    kept = [c for c in numbered.columns if c != "number"]
    schema = ", ".join(f"{c} {t}" for c, t in numbered.select(kept).dtypes) + ", sequence_id long, offset long"
    out = numbered.mapInArrow(place, schema)
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    return out.select(order)
