"""Building blocks that stay even when one group holds a third of the rows.

* `running` - running sums and running peaks per key, where every key is cut
  into time buckets, and a crowded bucket into pieces, whose totals are carried over;
* `ranked_values` - exact positions of every distinct value inside a group,
  without ever sorting the group in one task;
* `quantile` - exact interpolated quantiles read off those positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sampled rows: one in so many, by a hash of the row's place, so a retry samples the same rows.
SAMPLE = 4096
KEEP = 1024  # sampled rows kept of a bucket, those of the lowest hashes
CROWDED = 16  # sampled rows that make a bucket crowded
PIECES = 64  # of a crowded bucket
# Crowded buckets that are cut, the fullest first. A bucket that is not among them holds no more than
# about 1 / CUT of all rows, and CUT * (PIECES - 1) places are what a broadcast holds at most.
CUT = 4096


def _cuts(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Where to cut the crowded buckets: cell, `__cuts` (up to PIECES - 1 places in order).

    Per bucket the sampled rows of the lowest hashes are kept, cut in every task before the
    shuffle. The highest hash kept tells how full a bucket is: the fuller, the lower.
    """
    lowest = Window.partitionBy(*cell).orderBy("__hash")
    sampled = (
        rows.select(*cell, "__place", F.xxhash64(*cell, "__place").alias("__hash")).where(F.pmod("__hash", F.lit(SAMPLE)) == 0)
        .withColumn("__nth", F.row_number().over(lowest)).where(F.col("__nth") <= KEEP)
    )
    full = sampled.groupBy(*cell).agg(
        F.sort_array(F.collect_list("__place")).alias("__all"), F.count(F.lit(1)).alias("__n"), F.max("__hash").alias("__top"))
    step = F.col("__n") / F.lit(PIECES)
    cuts = F.transform(F.sequence(F.lit(1), F.lit(PIECES - 1)), lambda i: F.get("__all", F.floor(i * step).cast("int")))
    return (
        full.where(F.col("__n") >= CROWDED).orderBy(F.col("__n").desc(), "__top", *cell).limit(CUT)
        .select(*cell, F.array_distinct(cuts).alias("__cuts"))
    )


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    sums: dict[str, Column] | None = None,
    peaks: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and running maxima per key, up to and including the row.

    `bucket` must not decrease along `order`, columns that rise. Every key is cut alike: rows are windowed
    bucket by bucket, and what a key's earlier buckets add up to is joined on, from
    one row per key and bucket. A bucket with a great many rows, such as an import or a burst within an
    hour, is cut further at places of `order` found by a sample, so rows of one key and instant are spread as
    well where `order` goes on to tell them apart. Building it starts no job. A null key joins no carry, so
    give keys a value where their rows belong together.
    """
    sums, peaks = sums or {}, peaks or {}
    split = df.withColumns({"__bucket": bucket, "__place": F.struct(*order)})
    for name, col in {**sums, **peaks}.items():
        split = split.withColumn(f"__in_{name}", col)
    here = F.filter("__cuts", lambda cut: cut <= F.col("__place"))
    split = (
        split.join(F.broadcast(_cuts(split, [*keys, "__bucket"])), [*keys, "__bucket"], "left")
        .withColumn("__piece", F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(here))).drop("__cuts", "__place")
    )

    part = [*keys, "__bucket", "__piece"]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = split.select(
        "*",
        *[F.sum(f"__in_{n}").over(inside).alias(f"__at_{n}") for n in sums],
        *[F.max(f"__in_{n}").over(inside).alias(f"__at_{n}") for n in peaks],
    )

    before = Window.partitionBy(*keys).orderBy("__bucket", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = split.groupBy(*part).agg(
        *[F.sum(f"__in_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max(f"__in_{n}").alias(f"__t_{n}") for n in peaks],
    )
    carry = totals.select(
        *part,
        *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__c_{n}") for n in peaks],
    ).where(" or ".join(f"__c_{n} is not null" for n in (*sums, *peaks)))
    joined = local.join(carry, part, "left")
    return joined.select(
        *[c for c in df.columns],
        *[
            F.when(F.col(f"__at_{n}").isNull() & F.col(f"__c_{n}").isNull(), None)
            .otherwise(F.coalesce(f"__at_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)))
            .alias(n)
            for n in sums
        ],
        *[F.greatest(f"__at_{n}", f"__c_{n}").alias(n) for n in peaks],
    )


def beside(keys: list[str], *parts: DataFrame) -> DataFrame:
    """One row per key with the columns of all parts, each of which has at most one row per key.

    Same result as a chain of full joins on small aggregates, in one shuffle.
    """
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in out.columns if c not in keys])


def _value_bin(value: Column) -> Column:
    """64 bins per doubling: monotone, and even for money, counts and days."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * 64)).cast("long")


def ranked_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group and distinct value: rows below, rows up to it, rows in all.

    Columns: groups, value, `below`, `upto`, `total`. Equal values collapse
    before the shuffle, bins are counted, and only bins (a few thousand per
    group) are added up in one place; values are ordered bin by bin.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bin", _value_bin(F.col(value)))
    )
    bins = counted.groupBy(*groups, "__bin").agg(F.sum("__n").alias("__in_bin"))
    along = Window.partitionBy(*groups).orderBy("__bin")
    bins = bins.select(
        *groups,
        "__bin",
        (F.sum("__in_bin").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in_bin"))
        .alias("__base"),
        F.sum("__in_bin").over(Window.partitionBy(*groups)).alias("total"),
    )
    within = (
        Window.partitionBy(*groups, "__bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counted.withColumn("__cum", F.sum("__n").over(within))
        .join(bins, [*groups, "__bin"])
        .select(
            *groups,
            value,
            (F.col("__base") + F.col("__cum") - F.col("__n")).alias("below"),
            (F.col("__base") + F.col("__cum")).alias("upto"),
            "total",
        )
    )


def value_at(value: str, position: Column) -> Column:
    """Aggregate: the value at a zero-based position of the sorted group."""
    return F.max(F.when((F.col("below") <= position) & (position < F.col("upto")), F.col(value)))


def quantile(ranked: DataFrame, groups: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact quantile with linear interpolation, one row per group."""
    place = F.lit(float(q)) * (F.col("total") - 1)
    low = F.floor(place)
    picked = ranked.groupBy(*groups).agg(
        value_at(value, low).cast("double").alias("__lo"),
        value_at(value, F.ceil(place)).cast("double").alias("__hi"),
        F.max(place - low).alias("__frac"),
    )
    return picked.select(
        *groups,
        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias(name),
    )


def median_of(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    return quantile(ranked_values(df, groups, value), groups, value, 0.5, name)
