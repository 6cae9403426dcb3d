"""Connected components that grow: new links change what they touch, and nothing else is read or rewritten.

A store is a folder with three tables in hashed buckets, each written batch by batch and only ever added to:

* `holders` - (tenant_id, key, node): the first node seen with a key;
* `nodes` - (tenant_id, node, label): the component a node joined when it was first seen;
* `links` - (tenant_id, label, parent): a component that was absorbed, and by which.

A component is named by its lowest node, so names only ever fall. Of several parents of a label the
least is the newest, whatever the order of batches or their repeats, and the node table is never rewritten when
components merge. Batch n reads what earlier batches wrote, in the buckets of its own nodes and labels, and
overwrites its own folder when it is run again. Links are only added: where keys are
withdrawn, start a new store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.identity import TENANT, connected_components, follow_pointers
from patronage.session import settle
from patronage.streaming.jobs import _buckets_of, _run, _versions, _write_batch

# Fixed number per store. Many tasks' worth, and so many that a small batch touches few of them.
BUCKETS = 64
HOLDERS, NODES, LINKS = "holders", "nodes", "links"
SCHEMA = {
    HOLDERS: f"{TENANT} long, key string, node long",
    NODES: f"{TENANT} long, node long, label long",
    LINKS: f"{TENANT} long, label long, parent long",
}
KEY = {HOLDERS: "key", NODES: "node", LINKS: "label"}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _versions(spark, f"{path}/{name}", spark.createDataFrame([], SCHEMA[name]))


def _near(keys: DataFrame, path: str, name: str, batch: int) -> DataFrame:
    """Rows of earlier batches in the buckets that `keys` fall into; a folder of another bucket is not opened."""
    touched = _buckets_of(keys, TENANT, KEY[name], buckets=BUCKETS)
    return _table(keys.sparkSession, path, name).where(touched & (F.col("batch") < batch)).drop("bucket", "batch")


def _add(rows: DataFrame, path: str, name: str, batch: int) -> None:
    _write_batch(rows, f"{path}/{name}", batch, TENANT, KEY[name], buckets=BUCKETS)


def find(nodes: DataFrame, path: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """The components of some nodes (tenant_id, node) as of before `batch`.

    Returns (tenant_id, node, label), label null for a node never seen, and for the labels found
    (tenant_id, label, parent, root): the parent stored, null for none, and the component's name today.
    """
    seen = _near(nodes, path, NODES, batch)
    labelled = settle(nodes.join(seen, [TENANT, "node"], "left"))
    walk = settle(labelled.where("label is not null").select(TENANT, "label").distinct().select(
        TENANT, "label", F.lit(None).cast("long").alias("parent"), F.col("label").alias("root"), F.lit(True).alias("open")))
    while True:
        # Only labels whose end is not known yet take another step.
        heads = settle(walk.where("open").select(TENANT, F.col("root").alias("label")).distinct())
        if heads.isEmpty():
            return labelled, walk.drop("open")
        least = _near(heads, path, LINKS, batch).groupBy(TENANT, F.col("label").alias("root")).agg(F.min("parent").alias("next"))
        walk = settle(walk.join(least, [TENANT, "root"], "left").select(
            TENANT, "label", F.coalesce("parent", "next").alias("parent"), F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("open")))


def add_edges(edges: DataFrame, path: str, batch: int) -> None:
    """Add links (tenant_id, u, v) between nodes; a link of a node with itself makes the node known.

    The rounds run over components instead of nodes: a link inside a component drops out before them, and
    of a large component only its name takes part. Rows with a null are left out.
    """
    edges = settle(edges.select(TENANT, "u", "v").dropna().distinct())
    ends = settle(edges.select(TENANT, F.col("u").alias("node")).unionByName(edges.select(TENANT, F.col("v").alias("node"))).distinct())
    labelled, labels = find(ends, path, batch)
    home = settle(labelled.join(labels.select(TENANT, "label", "root"), [TENANT, "label"], "left").select(
        TENANT, "node", "label", F.coalesce("root", "node").alias("root")))
    side = lambda end: home.select(TENANT, F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = edges.where("u <> v").join(side("u"), [TENANT, "u"]).join(side("v"), [TENANT, "v"]).where("root_u <> root_v")
    joined = connected_components(between.select(TENANT, F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    merged = settle(joined.select(TENANT, F.col("node").alias("root"), "component"))
    now = F.coalesce("component", "root")
    new = home.where("label is null").join(merged, [TENANT, "root"], "left").select(TENANT, "node", now.alias("label"))
    # Every label met points straight at its component afterwards, so walks stay short.
    moved = labels.join(merged, [TENANT, "root"], "left").select(TENANT, "label", "parent", now.alias("root"))
    moved = moved.unionByName(_absorbed(labels, merged))
    links = moved.where("root < label").where("parent is null or root < parent").select(TENANT, "label", F.col("root").alias("parent")).distinct()
    _add(links, path, LINKS, batch)
    _add(new, path, NODES, batch)


def _absorbed(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Roots known before that were absorbed, whether or not a node still carries them as its label."""
    roots = labels.select(TENANT, "root").distinct()
    return roots.join(merged, [TENANT, "root"]).select(
        TENANT, F.col("root").alias("label"), F.lit(None).cast("long").alias("parent"), F.col("component").alias("root"))


def add_pairs(pairs: DataFrame, path: str, batch: int) -> None:
    """Add (tenant_id, node, key): nodes that hold a key in common belong together, now and in later batches.

    A key held by n nodes of a batch gives n links, to the node known to hold it or else to the lowest of them.
    """
    pairs = settle(pairs.select(TENANT, "node", "key").dropna().distinct())
    low = settle(pairs.groupBy(TENANT, "key").agg(F.min("node").alias("low")))
    known = _near(low, path, HOLDERS, batch).withColumnRenamed("node", "holder")
    held = settle(low.join(known, [TENANT, "key"], "left"))
    add_edges(pairs.join(held, [TENANT, "key"]).select(TENANT, F.col("node").alias("u"), F.coalesce("holder", "low").alias("v")), path, batch)
    _add(held.where("holder is null").select(TENANT, "key", F.col("low").alias("node")), path, HOLDERS, batch)


def components(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, node, component) of all nodes of a store; component is its lowest node."""
    least = _table(spark, path, LINKS).groupBy(TENANT, "label").agg(F.min("parent").alias("parent"))
    ends = follow_pointers(least, "label", "parent")
    return _table(spark, path, NODES).join(ends, [TENANT, "label"], "left").select(
        TENANT, "node", F.coalesce("root", "label").alias("component"))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write a store anew as a single batch, number 0, without chains of absorbed components; go on from batch 1."""
    _add(components(spark, path).withColumnRenamed("component", "label"), into, NODES, 0)
    _add(_table(spark, path, HOLDERS).drop("bucket", "batch"), into, HOLDERS, 0)


def stream_components(pairs: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Components of a stream of (tenant_id, node, key), kept up to date batch by batch."""
    spark = pairs.sparkSession
    _run(pairs, lambda rows, batch: add_pairs(rows, path, batch), checkpoint)
    return components(spark, path)
