"""Token ids in Arrow files of equal-length sequences.

The ids of all documents, in ascending doc_id order, run through files of
`seq_len`-long sequences: an `input_ids` column of fixed-size lists of unsigned
integers and a `mask` column of fixed-size lists of bits (false: padding). A file
is Arrow's stream format closed by a footer that names every batch's place, and
all batches but the last hold the same number of sequences; so sequence i is found by
arithmetic and read without copying. A second file beside it holds the documents'
places. Only the last sequence of a file is padded.

Documents are dealt to files by doc_id range, so a file's first id is the sum of
the ids in the files before it. Task attempts write files of their own, and the
manifest, a table that Spark commits, names the ones that count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.llm.common import per_batch, per_worker, shared, stored, texts_of, vocabulary
from patronage.llm.encoding import Encoder
from patronage.session import work_path

SEQ_LEN = 2048
PER_BATCH = 256
BATCH = 500
MANIFEST = "file string, first_doc long, first_tie long, n_tokens long, n_docs long, n_sequences long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))


class SequenceWriter:
    """One file of sequences and one of document places; memory is one batch."""

    def __init__(self, filesystem: pafs.FileSystem, path: str, width: np.dtype, seq_len: int, per_batch: int):
        self.seq_len, self.rows, self.width = seq_len, per_batch, width
        item = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("input_ids", pa.list_(item, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))],
                                metadata={"seq_len": str(seq_len), "per_batch": str(per_batch)})
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.sinks = [filesystem.open_output_stream(f"{path}.sequences.arrow"), filesystem.open_output_stream(f"{path}.documents.arrow")]
        self.out, self.index = (pa.ipc.new_file(s, k) for s, k in zip(self.sinks, (self.schema, self.places)))
        self.held, self.n_held, self.n_tokens, self.n_docs, self.n_sequences = [], 0, 0, 0, 0

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        starts, lengths = [], []
        for ids in encoded:
            own = np.frombuffer(ids, dtype="<u4")
            starts.append(self.n_tokens)
            lengths.append(len(own))
            self.held.append(own.astype(self.width))
            self.n_tokens += len(own)
            self.n_held += len(own)
            if self.n_held >= self.rows * self.seq_len:
                self._flush(False)
        self.n_docs += len(doc_ids)
        self.index.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=self.places))

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.width)
        block = self.rows * self.seq_len
        at = 0
        while len(flat) - at >= block or (last and at < len(flat)):
            part = flat[at:at + block]
            n = -(-len(part) // self.seq_len)
            ids, mask = np.zeros(n * self.seq_len, self.width), np.zeros(n * self.seq_len, bool)
            ids[:len(part)], mask[:len(part)] = part, True
            self.out.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
            self.n_sequences += n
            at += len(part)
        self.held, self.n_held = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.index, *self.sinks):
            x.close()


class SequenceFile:
    """Random access to one file of sequences; ids and masks are views, nothing is copied."""

    def __init__(self, filesystem: pafs.FileSystem, path: str):
        local = isinstance(filesystem, pafs.LocalFileSystem)
        opened = [pa.memory_map(p) if local else filesystem.open_input_file(p) for p in (f"{path}.sequences.arrow", f"{path}.documents.arrow")]
        self.reader, self.index = (pa.ipc.open_file(x) for x in opened)
        said = self.reader.schema.metadata
        self.seq_len, self.per_batch = int(said[b"seq_len"]), int(said[b"per_batch"])
        self._at, self._batch = -1, None

    def batch(self, n: int) -> pa.RecordBatch:
        if n != self._at:
            self._at, self._batch = n, self.reader.get_batch(n)
        return self._batch

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence i: its ids, and which of them are not padding."""
        rows, at = self.batch(i // self.per_batch), i % self.per_batch
        ids = rows.column(0).flatten().to_numpy(zero_copy_only=True)[at * self.seq_len:(at + 1) * self.seq_len]
        return ids, rows.column(1).flatten().slice(at * self.seq_len, self.seq_len)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, in views of at most a batch."""
        block = self.seq_len * self.per_batch
        while n:
            flat = self.batch(start // block).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % block:start % block + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def write_sequences(docs: DataFrame, tokenizer: str, folder: str | None = None, seq_len: int = SEQ_LEN,
                    end_id: int = 1, per_file: int = PER_BATCH, partitions: int | None = None) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) and return the manifest, one row per file.

    folder: where to write, by default a new one in the shared folder; any address
    pyarrow can open from the executors. partitions: number of doc_id ranges, by
    default Spark's. Ids take 16 bits where the vocabulary allows it, else 32.

    Defined cases: null or empty text is the end id alone; a null doc_id comes
    first; rows with the same doc_id lie side by side, in the order of their text's
    hash, and are written once each; an empty table gives no file. Other columns
    are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "sequences")
    spec = vocabulary(tokenizer)
    sent = shared(spark, spec)
    from tokenizers import Tokenizer

    largest = max([end_id, *Tokenizer.from_str(spec).get_vocab(with_added_tokens=True).values()])
    width = np.dtype("<u2") if largest < 2**16 else np.dtype("<u4")
    end = np.array([end_id], dtype="<u4").tobytes()
    spec_name = zlib.crc32(spec.encode())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = first = None
        encode = per_worker(("encoder", spec_name), lambda: Encoder(sent.value))
        filesystem, base = _open(folder)
        name = uuid.uuid4().hex
        for batch in per_batch(BATCH, batches):
            if out is None:
                out = SequenceWriter(filesystem, f"{base}/{name}", width, seq_len, per_file)
                first = (batch.column(0)[0].as_py(), batch.column(2)[0].as_py())
            out.add(batch.column(0).to_pylist(), [ids + end for ids in encode(texts_of(batch))])
        if out is not None:
            out.close()
            row = [(name,), (first[0],), (first[1],), (out.n_tokens,), (out.n_docs,), (out.n_sequences,)]
            kinds = [pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    dealt = own.repartitionByRange(partitions, "doc_id", "tie") if partitions else own.repartitionByRange("doc_id", "tie")
    manifest = stored(dealt.sortWithinPartitions("doc_id", "tie").mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("first_doc", "first_tie").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files a manifest names: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, base = _open(row["folder"])
                file = SequenceFile(filesystem, f"{base}/{row['file']}")
                for docs in file.documents():
                    crcs = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc = 0
                        for part in file.ids(start, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + row["base"])
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(load, schema)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_documents(write_sequences(docs, tokenizer))
