"""Session settings the engine relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that can be changed on a running session. The skew settings make
# AQE split a hot join key across tasks, also below an aggregation. The group
# limit lets a top-k per tenant be cut in every task before the shuffle, for any
# page a caller may ask for.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, app: str = "patronage") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Checkpoint files go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Small local inputs: keep all cores busy instead of one large partition.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording call sites costs a round trip per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a session on one machine without that setting, as in tests, gets a folder
    of its own; on a cluster a machine's own folder would lose files, so that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = jdir.get() if jdir.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        known = tempfile.mkdtemp(prefix="patronage-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/patronage-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage into the reliable checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def settle_sizeless(df: DataFrame) -> DataFrame:
    """`settle` for a table that a loop joins to what came of it: without the size that Spark estimates.

    A settled table keeps its estimate, and the estimate of a join is the product of its sides'. Where a step joins
    the table of the step before more than once, the digits of that number double every step until it fills the driver.
    """
    done = settle(df)
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
