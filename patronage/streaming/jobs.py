"""Incremental forms of landing, event deduplication and consent state.

All three read a folder of files as it grows, resume from their own checkpoint
folder, and stop when nothing is left to read (`availableNow`). Their results
lie in a Parquet table, and equal what the batch operators give on all files, in
whatever order and however late the files arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.sources.crm import FLAG_CHANNELS
from patronage.sources.landing import RAW_KEY, land_raw
from patronage.sources.sinks import _folder

BUCKETS = 64
# State on local disk with checkpointed snapshots instead of on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, write, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _bucket(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows of a table laid out as bucket=/batch=, with both as columns."""
    schema = like.withColumn("bucket", F.lit(None).cast("int")).withColumn("batch", F.lit(None).cast("long")).schema
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _buckets_of(rows: DataFrame, *keys: str, buckets: int = BUCKETS) -> Column:
    """Condition on `bucket`: the buckets that some rows fall into. Plain numbers, so that the scan lists no others' files."""
    touched = [r[0] for r in rows.select(_bucket(*keys, buckets=buckets).alias("b")).distinct().collect()]  # at most `buckets` numbers
    return F.col("bucket").isin(touched)


def _write_batch(rows: DataFrame, path: str, batch: int, *keys: str, buckets: int = BUCKETS) -> None:
    """One folder per bucket and batch; a retried batch overwrites its own."""
    (
        rows.withColumn("bucket", _bucket(*keys, buckets=buckets)).withColumn("batch", F.lit(batch).cast("long"))
        .repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch").parquet(path)
    )


def stream_land_raw(source: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Land new records once each, however often a batch is retried.

    Records lie in buckets by their key. A batch compares its keys with those of
    earlier batches in the buckets it touches, and reads nothing but the keys there.
    """
    spark = source.sparkSession
    like = spark.createDataFrame([], source.schema)

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        before = _versions(rows.sparkSession, path, like).where((F.col("batch") < batch) & _buckets_of(rows, *RAW_KEY))
        _write_batch(land_raw(rows, before.select(*RAW_KEY)), path, batch, *RAW_KEY)
        rows.unpersist()

    _run(source, write, checkpoint)
    return _versions(spark, path, like).select(*source.columns)


def stream_event_dedup(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Keep the first arrival of each event id, however late an event or a repeat comes.

    The state holds the ids seen, partitioned over the tasks and kept on disk. There is no
    watermark: nothing is dropped for being late.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        events.dropDuplicates(["event_id"]).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(path)


def stream_consent_state(ledger: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Last action per customer and channel, kept up to date batch by batch.

    A late record only wins by its own time. The state lies in buckets by customer. A batch merges its
    rows into the buckets it touches and writes their next version; of the versions before,
    the last stays for a retry and older ones go. So state grows with the customers, not with the ledger.
    """
    key = ["tenant_id", "customer_id", "channel"]
    fields = ["occurred_at", "consent_id", "action"]
    by = ["tenant_id", "customer_id"]
    spark = ledger.sparkSession
    like = spark.createDataFrame([], ledger.select(*key, *fields).schema)

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.max(F.struct(*fields)).alias("s")).select(*key, "s.*")

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        rows.persist()
        before = _current(_versions(session, path, like).where((F.col("batch") < batch) & _buckets_of(rows, *by)))
        merged = newest(rows.select(*key, *fields).unionByName(before.select(*key, *fields)))
        _write_batch(merged, path, batch, *by)
        _drop_superseded(session, path, batch)
        rows.unpersist()

    _run(ledger, write, checkpoint)
    return _current(_versions(spark, path, like)).select(*key, *fields)


def _current(versions: DataFrame) -> DataFrame:
    """The rows of each bucket's newest version."""
    last = versions.groupBy("bucket").agg(F.max("batch").alias("batch"))  # at most BUCKETS rows
    return versions.join(F.broadcast(last), ["bucket", "batch"], "left_semi")


def _drop_superseded(spark: SparkSession, path: str, batch: int) -> None:
    """Delete versions that neither a reader nor a retry of `batch` can need; looks at BUCKETS folders."""
    fs, where = _folder(spark, path)
    for bucket in fs.listStatus(where) if fs.exists(where) else []:
        found = sorted(
            (int(v.getPath().getName().split("=")[1]), v.getPath())
            for v in fs.listStatus(bucket.getPath()) if v.getPath().getName().startswith("batch=")
        ) if bucket.isDirectory() else []
        before = [p for n, p in found if n < batch]
        for old in before[:-1]:
            fs.delete(old, True)


def consent_flags_of(state: DataFrame) -> DataFrame:
    """Opt-in flags from the streamed state, as the batch operator gives them."""
    return state.groupBy("tenant_id", "customer_id").agg(*[
        F.max(F.when(F.col("channel") == channel, F.col("action") == "granted")).alias(flag)
        for channel, flag in FLAG_CHANNELS.items()
    ])
