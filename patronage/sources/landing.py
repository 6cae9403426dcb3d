"""Landing, cursors, upserts and ids: the parts of a sync that know no payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_KEY = ["tenant_id", "source", "resource", "external_id"]
STREAM = ["tenant_id", "source", "resource"]
ID_BUCKETS = 4096


def land_raw(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Payloads to append: the first of each key, unless the key has landed before."""
    rest = [c for c in new.columns if c not in (*RAW_KEY, "seq")]
    first = new.groupBy(*RAW_KEY).agg(F.min_by(F.struct("seq", *rest), F.col("seq")).alias("r"))
    return (
        first.join(existing.select(*RAW_KEY), RAW_KEY, "left_anti").select(*RAW_KEY, "r.*").select(*new.columns)
    )


def read_since(raw: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Records beyond the stored cursor of their stream; all of a stream never read."""
    cursors = sync_state.select(*STREAM, F.col("cursor").cast("long").alias("__cursor"))
    return (
        raw.join(cursors, STREAM, "left")
        .where(F.col("__cursor").isNull() | (F.col("seq") > F.col("__cursor")))
        .drop("__cursor")
    )


def advance(sync_state: DataFrame, read: DataFrame, at: str) -> DataFrame:
    """The cursor table after `read`; a stream with nothing new keeps its cursor."""
    moved = read.groupBy(*STREAM).agg(F.max("seq").cast("string").alias("__cursor"))
    now = F.lit(at).cast("timestamp_ntz")
    return sync_state.join(moved, STREAM, "full").select(
        *STREAM, F.coalesce("__cursor", "cursor").alias("cursor"),
        F.when(F.col("__cursor").isNotNull(), now).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row per key: the incoming row with the highest `order_col`, else the current one."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("__new", order_col)).alias("r")
    return both.groupBy(*keys).agg(newest).select(*keys, "r.*").select(*current.columns)


def assign_ids(known: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Give each key of `rows` its known id, or the next free one.

    New ids are dense and depend only on the keys: keys are numbered inside hash
    buckets, and bucket sizes are added up, so no single task sees all of them.
    """
    fresh = rows.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
    bucketed = fresh.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(ID_BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("__b").agg(F.count(F.lit(1)).alias("__size"))
    # The highest known id comes in as a bucket of its own, before all others;
    # at most ID_BUCKETS + 1 rows meet in this window.
    top = known.agg(F.coalesce(F.max(name), F.lit(0)).alias("__size")).select(F.lit(-1).alias("__b"), "__size")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = top.unionByName(sizes).select(
        "__b", F.sum("__size").over(before).alias("__start")
    )
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*keys))
    numbered = bucketed.withColumn("__n", place).join(F.broadcast(base), "__b").select(
        *keys, (F.col("__start") + F.col("__n")).cast("long").alias(name)
    )
    return rows.join(known.select(*keys, name).unionByName(numbered), keys)


def source_freshness(sync_state: DataFrame, runs: DataFrame) -> DataFrame:
    """Last sync per source, beside the tenant's last score run and its version."""
    last = runs.groupBy("tenant_id").agg(
        F.max(F.struct("computed_at", "run_id", "definition_version")).alias("r")
    ).select("tenant_id", F.col("r.computed_at").alias("last_score_run_at"), "r.definition_version")
    return (
        sync_state.groupBy("tenant_id", "source").agg(F.max("last_synced_at").alias("last_synced_at"))
        .join(last, "tenant_id", "left")
    )


def sync_report(fetched: DataFrame, existing: DataFrame, upserted: DataFrame | None = None) -> DataFrame:
    """Fetched, inserted, skipped and upserted per stream of one sync run.

    A record is inserted when its key is new, and only once; every other copy is
    skipped. `upserted` has the streams' core rows, all fetched ones by default.
    """
    per_key = fetched.groupBy(*RAW_KEY).agg(F.count(F.lit(1)).alias("n"))
    seen = existing.select(*RAW_KEY, F.lit(1).alias("seen"))
    counted = per_key.join(seen, RAW_KEY, "left").groupBy(*STREAM).agg(
        F.sum("n").alias("fetched"), F.count_if(F.col("seen").isNull()).alias("inserted_raw")
    )
    counted = counted.withColumn("skipped", F.col("fetched") - F.col("inserted_raw"))
    if upserted is None:
        return counted.withColumn("upserted", F.col("fetched"))
    done = upserted.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("upserted"))
    return counted.join(done, STREAM, "left").na.fill(0, ["upserted"])


# The words a status column may hold.
VOCABULARY = {
    "orders": {
        "financial_status": ("pending", "authorized", "paid", "partially_refunded", "refunded", "voided"),
        "fulfillment_status": ("unfulfilled", "partial", "fulfilled", "delivered", "rto"),
    },
    "shipments": {"status": ("pending", "in_transit", "delivered", "rto_initiated", "rto_received", "lost")},
    "payments": {
        "status": ("created", "authorized", "captured", "failed", "refunded"),
        "method": ("upi", "card", "netbanking", "wallet", "cod"),
    },
    "refunds": {"refund_type": ("return", "rto", "goodwill", "payment_failure")},
    "consent": {"channel": ("email", "whatsapp", "sms"), "action": ("granted", "revoked")},
    "customers": {"lifecycle_stage": ("new", "active", "loyal", "slipping", "dormant", "lost")},
    "experiments": {"status": ("draft", "running", "concluded"), "decision": ("shipped", "killed", "inconclusive")},
}


def validate_enums(df: DataFrame, table: str, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows outside the vocabulary, counted per tenant, column and word; null is allowed."""
    rules = VOCABULARY[table] if rules is None else rules
    words = F.array(*[
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed),
               F.struct(F.lit(c).alias("column"), F.col(c).alias("word")))
        for c, allowed in rules.items()
    ])
    return (
        df.select("tenant_id", F.explode(F.array_compact(words)).alias("w"))
        .groupBy("tenant_id", F.lit(table).alias("table"), "w.column", "w.word")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def quality_profile(orders: DataFrame, shipments: DataFrame, items: DataFrame) -> DataFrame:
    """How plausible a tenant's book is: repeat, COD and guest share, mean order, returns, zero prices."""
    def rate(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    book = orders.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("orders"), rate(F.col("cod")).alias("cod_share"),
        rate(F.col("customer_id").isNull()).alias("guest_share"), F.avg("total_paise").alias("mean_order_paise"),
    )
    buyers = (
        orders.where(F.col("customer_id").isNotNull()).groupBy("tenant_id", "customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tenant_id").agg(rate(F.col("n") >= 2).alias("repeat_buyer_rate"))
    )
    sent = shipments.groupBy("tenant_id").agg(
        F.count_if("rto").alias("rto_shipments"),
        F.count_if(F.col("rto") & (F.col("rto_at").isNull() | F.col("delivered_at").isNotNull()
                                   | (F.col("status") != "rto_received"))).alias("rto_inconsistent"),
        F.count_if(~F.col("rto") & F.col("rto_at").isNotNull()).alias("rto_date_without_rto"),
    )
    priced = items.groupBy("tenant_id").agg(F.count_if(F.col("unit_price_paise") == 0).alias("zero_priced_items"))
    return book.join(buyers, "tenant_id", "left").join(sent, "tenant_id", "left").join(priced, "tenant_id", "left")


def non_integral_money(df: DataFrame) -> list[str]:
    """Money columns that are not stored as whole paise."""
    return [c for c, t in df.dtypes if c.endswith("_paise") and t not in ("bigint", "int")]
