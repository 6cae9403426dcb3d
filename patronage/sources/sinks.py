"""Tables on shared storage, in hashed tenant buckets, replaced tenant by tenant.

A tenant's rows lie in one bucket folder, so the number of folders does not grow with the
tenants. Replacing some tenants rewrites their buckets, other tenants' rows
included, in one dynamic overwrite that Spark commits as a whole: nothing is listed or deleted by
hand. A tenant in scope leaves a marker row, so a bucket whose rows are all gone is
overwritten like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.session import settle

BUCKETS = 256
BUCKET, MARKER = "tenant_bucket", "is_marker"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def bucket_of(tenant: Column) -> Column:
    return F.pmod(F.hash(tenant), F.lit(BUCKETS))


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the folders that `df` has rows for.

    Rebalancing gathers a folder's rows into few files and still spreads a
    large one over many tasks.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The table as it lies there, markers and buckets included; None when nothing was written yet."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return None
    schema = like.withColumn(MARKER, F.lit(None).cast("boolean")).withColumn(BUCKET, F.lit(None).cast("int")).schema
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table; empty, in the shape of `like`, when nothing was written yet."""
    stored = _stored(spark, path, like)
    if stored is None:
        return like.limit(0)
    return stored.where(~F.coalesce(MARKER, F.lit(False))).select(*like.columns)


def _replace(df: DataFrame, path: str, scope: DataFrame, by: list[str]) -> None:
    """Put `df` in place of all stored rows with the keys of `scope` (tenant_id and what `by` names besides)."""
    keys = ["tenant_id", *by]
    place = bucket_of(F.col("tenant_id")).alias(BUCKET)
    scope = settle(scope.select(*keys).distinct().select("*", place))
    new = df.withColumn(MARKER, F.lit(False)).withColumn(BUCKET, bucket_of(F.col("tenant_id")))
    marks = scope.withColumn(MARKER, F.lit(True))
    rows = new.unionByName(marks, allowMissingColumns=True)
    stored = _stored(df.sparkSession, path, df)
    if stored is not None:
        touched = scope.select(BUCKET, *by).distinct()
        others = stored.join(touched, [BUCKET, *by], "left_semi").join(scope.select(*keys), keys, "left_anti")
        rows = rows.unionByName(others)
    _write(rows, path, [BUCKET, *by])


def write_replace(df: DataFrame, path: str, tenants: DataFrame) -> None:
    """Replace the rows of all tenants in `tenants`; other tenants stay as they are, and a tenant without new rows has none."""
    _replace(df, path, tenants, [])


def write_predictions(df: DataFrame, path: str) -> None:
    """A day's rows replace that tenant's rows of the same day; other days stay."""
    rows = settle(df)
    _replace(rows, path, rows, ["scored_on"])


def append_runs(df: DataFrame, path: str) -> None:
    """Score runs are only ever added."""
    df.withColumn(BUCKET, bucket_of(F.col("tenant_id"))).write.mode("append").partitionBy(BUCKET).parquet(path)
