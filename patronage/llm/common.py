"""What the operators share: reading tables, written intermediate tables, tokenizer files, vectors."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.session import work_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few megabytes, however long the texts; a limit that the session has stays."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


_scratch: list[list[str]] = []  # the paths of every open `scratch`, the innermost last


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end, but for those stored with `keep`. What is to outlast it must be stored so."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write `df` into the shared folder and read it back: lost executors cost nothing before it.

    keep: the table outlasts the innermost `scratch`.
    """
    path = work_path(df.sparkSession, label)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def vocabulary(path: str) -> str:
    """The text of a tokenizer file. The driver reads it; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Shared:
    """A broadcast value whose classes travel by value, as task code does."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        if "loaded" not in self.__dict__:
            self.loaded = pickle.loads(self.sent.value)
        return self.loaded

    def __getstate__(self) -> dict:
        return {"sent": self.sent}


def shared(spark: SparkSession, value: object) -> Shared:
    """Broadcast something whose size is bounded by parameters, not by the data."""
    return Shared(spark, value)


def per_worker(key: tuple, build: Callable[[], Any]) -> Any:
    """What `build` makes, once per Python worker process; tasks bring their code anew, so it is kept outside of it."""
    kept = sys.modules.setdefault("_patronage_worker", ModuleType("_patronage_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def forget() -> None:
    """Drop what `per_worker` keeps for the operators that ran before, such as a tokenizer and its pieces; they make it again."""
    kept = sys.modules.get("_patronage_worker")
    if kept and any(isinstance(key, tuple) for key in kept.__dict__):
        del sys.modules["_patronage_worker"]
        del kept
        gc.collect()
        give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def crc_of_text(doc_ids: pa.Array) -> np.ndarray:
    import zlib

    return np.array([-1 if v is None else zlib.crc32(str(v).encode()) for v in doc_ids.to_pylist()], dtype=np.int64)


def give_back() -> None:
    """Return what a worker no longer needs to the system; workers live on after a task and are many on a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_batch(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no step holds more than `rows` texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
