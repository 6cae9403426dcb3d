"""Streams in several small batches, late and repeated rows included."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patronage.sources import sinks
from patronage.streaming import jobs

DAY = datetime(2025, 6, 1)


def stream(spark, tmp_path, schema, *batches):
    """One file, and one micro-batch, per list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in*")


def test_late_events_are_kept(spark, tmp_path):
    schema = "event_id string, occurred_at timestamp_ntz"
    old = DAY - timedelta(days=10)
    events = stream(spark, tmp_path, schema, [("a", DAY), ("b", DAY)], [("c", DAY + timedelta(days=5)), ("a", DAY)],
                    [("d", old), ("e", old), ("b", DAY)])
    out = jobs.stream_event_dedup(events, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert sorted(r.event_id for r in out.collect()) == list("abcde")


CONSENT = "tenant_id long, consent_id long, customer_id long, channel string, action string, occurred_at timestamp_ntz"


def test_consent_state_is_merged_not_piled_up(spark, tmp_path):
    batches = [[(1, 10 * b + c, c, "email", "granted" if b % 2 else "revoked", DAY + timedelta(days=b if b < 4 else -9)) for c in range(5)] for b in range(5)]
    ledger = stream(spark, tmp_path, CONSENT, *batches)
    state = jobs.stream_consent_state(ledger, f"{tmp_path}/state", f"{tmp_path}/ckpt")
    assert {(r.customer_id, r.action) for r in state.collect()} == {(c, "granted") for c in range(5)}  # the fifth batch is late and loses
    versions = [len(glob.glob(f"{b}/batch=*")) for b in glob.glob(f"{tmp_path}/state/bucket=*")]
    assert versions and max(versions) <= 2


def test_landing_compares_with_earlier_batches(spark, tmp_path):
    schema = "tenant_id long, source string, resource string, external_id string, seq long, payload string"
    row = lambda e, seq: (1, "shop", "orders", e, seq, f"p{seq}")
    source = stream(spark, tmp_path, schema, [row("x", 1), row("y", 2)], [row("x", 3), row("z", 4), row("z", 5)], [row("y", 6)])
    landed = jobs.stream_land_raw(source, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert sorted((r.external_id, r.seq) for r in landed.collect()) == [("x", 1), ("y", 2), ("z", 4)]


def test_only_the_buckets_of_a_batch_are_listed(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    path = f"{tmp_path}/t"
    jobs._write_batch(rows, path, 0, "k")
    few = rows.where("k in (3, 4)")
    held = jobs._versions(spark, path, rows).where(jobs._buckets_of(few, "k"))
    listed = {r.bucket for r in held.select("bucket").distinct().collect()}
    assert listed == {r.b for r in few.select(jobs._bucket("k").alias("b")).collect()}
    scan = held._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in scan and few.join(held, "k", "left_anti").count() == 0
    assert jobs._versions(spark, path, rows).where(jobs._buckets_of(rows.limit(0), "k")).count() == 0


def test_replacing_a_tenant_leaves_the_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BUCKETS", 2)  # tenants share buckets
    path, schema = f"{tmp_path}/t", "tenant_id long, v long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    tenants = spark.createDataFrame([(t,) for t in range(6)] + [(None,)], "tenant_id long")
    sinks.write_replace(make(*[(t, 1) for t in range(6)], (None, 1)), path, tenants)
    sinks.write_replace(make((2, 9)), path, tenants.where("tenant_id in (2, 3)"))
    got = sorted((r.tenant_id, r.v) for r in sinks.read_table(spark, path, make((0, 0))).where("tenant_id is not null").collect())
    assert got == [(0, 1), (1, 1), (2, 9), (4, 1), (5, 1)]
    sinks.write_replace(make((0, 0)).limit(0), path, tenants.where("tenant_id is not null"))
    assert [r.tenant_id for r in sinks.read_table(spark, path, make((0, 0))).collect()] == [None]


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from patronage import session

    class Context:
        master = "spark://somewhere:7077"

    class Fake:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    Fake.sparkContext._jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {
        "getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())
