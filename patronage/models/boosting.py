"""Boosted trees for a binary label, one ensemble per tenant, all tenants grown in the same passes.

Tenants of at most `TOGETHER` rows, counted, are dealt to tasks, each whole; one stage grows them all. The trees of
larger tenants grow side by side in passes: a pass over the rows grows one level of one tree of each; rows are placed by the levels that
stand, gradients and curvatures are added up per tenant, node, feature and bin, and the best cut of each node is
chosen as rows. What a shuffle carries is bounded by nodes, features and bins, and combined before it, so a tenant with a third of all rows
costs no task more than another. The stages do not grow with the tenants; the driver sees no tenant and no row. Sums are of
fixed-point integers, so trees are the same under any partitioning, and both ways give the same trees.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.operators.scale import ranked_values
from patronage.session import settle, settle_sizeless

FINE = float(1 << 28)  # fixed point of a gradient; sums stay exact over 2 ** 34 rows of a node
BROADCAST_TENANTS = 10_000  # tenants whose trees (under a kilobyte each) go to every task; more are joined by their key
TOGETHER = 200_000  # rows of a tenant that one task may hold; more are grown by passes, to the same trees
SPLITS = "map<int,struct<feature:int,bin:int>>"


@dataclass(frozen=True)
class Trees:
    rounds: int = 10
    depth: int = 3
    bins: int = 32
    rate: float = 0.4
    least: int = 10  # rows on either side of a cut
    ridge: float = 1.0


def feature_cuts(rows: DataFrame, features: tuple[str, ...], bins: int) -> DataFrame:
    """Per tenant and feature the starts of its bins but the first, ascending: tenant_id, cuts map<int,array<double>>.

    A value's bin is the floor of bins times its share of smaller values, so equal values share one; exact at every size.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    long = rows.select("tenant_id", F.posexplode(values).alias("feature", "value")).where(~F.isnan("value"))
    ranked = ranked_values(long, ["tenant_id", "feature"], "value")
    starts = ranked.groupBy("tenant_id", "feature", F.floor(F.col("below") * bins / F.col("total")).alias("bin")).agg(F.min("value").alias("start"))
    each = starts.groupBy("tenant_id", "feature").agg(F.array_sort(F.collect_list(F.when(F.col("bin") > 0, F.col("start")))).alias("starts"))
    return each.groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "starts"))).alias("cuts"))


def _bins(features: tuple[str, ...]) -> Column:
    """Bin per feature from 1 on; 0 is for null and NaN."""
    def one(i: int, name: str) -> Column:
        value = F.col(name).cast("double")
        upto = F.filter(F.coalesce(F.col("cuts")[i], F.array().cast("array<double>")), lambda c: c <= value)
        return F.when(value.isNull() | F.isnan(value), 0).otherwise(F.size(upto) + 1)

    return F.array(*[one(i, f) for i, f in enumerate(features)])


def _walk(x: Column, splits: Column, levels: int) -> Column:
    """The node that a row reaches: 1 is the root, 2n and 2n + 1 lie below n; a node without a cut passes its rows left."""
    def down(node: Column, _: Column) -> Column:
        cut = splits[node]
        return node * 2 + F.coalesce((x[cut["feature"]] > cut["bin"]).cast("int"), F.lit(0))

    return F.aggregate(F.array(*[F.lit(i) for i in range(levels)]), F.lit(1), down) if levels else F.lit(1)


def histogram(placed: DataFrame) -> DataFrame:
    """Rows, gradient and curvature per tenant, node, feature and bin of `placed` (tenant_id, node, x, g, h)."""
    cells = placed.select("tenant_id", "node", "g", "h", F.posexplode("x").alias("feature", "bin"))
    return cells.groupBy("tenant_id", "node", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_cuts(cells: DataFrame, spec: Trees) -> DataFrame:
    """One row per tenant and node: its cut of highest gain (ties: first feature, lowest bin) or null, and the values on either side.

    Columns: tenant_id, node, gain, feature, bin, left, right; without a cut `left` is the value of the whole node.
    """
    group = Window.partitionBy("tenant_id", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("*", *[F.sum(c).over(w).alias(f"{c}_{k}") for k, w in (("left", upto), ("all", group)) for c in ("n", "g", "h")])
    real = lambda c: c.cast("double") / FINE
    sides = {"left": (F.col("g_left"), F.col("h_left")), "all": (F.col("g_all"), F.col("h_all")),
             "right": (F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left"))}
    worth = {k: real(g) * real(g) / (real(h) + spec.ridge) for k, (g, h) in sides.items()}
    value = {k: -real(g) / (real(h) + spec.ridge) * spec.rate for k, (g, h) in sides.items()}
    gain = worth["left"] + worth["right"] - worth["all"]
    fair = (F.col("n_left") >= spec.least) & (F.col("n_all") - F.col("n_left") >= spec.least) & (gain > 0)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"),
                   value["left"].alias("left"), value["right"].alias("right"))
    best = sums.groupBy("tenant_id", "node").agg(F.max(F.when(fair, cut)).alias("cut"), F.max(value["all"]).alias("whole"))
    return best.select(
        "tenant_id", "node", F.col("cut.gain").alias("gain"), (-F.col("cut.feature")).alias("feature"), (-F.col("cut.bin")).alias("bin"),
        F.coalesce("cut.left", "whole").alias("left"), F.coalesce("cut.right", "whole").alias("right"))


def gradients(margin: Column, label: Column) -> tuple[Column, Column]:
    """Gradient and curvature of the logistic loss as fixed-point integers."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    whole = lambda c: F.rint(c * FINE).cast("long")
    return whole(p - label), whole(p * (F.lit(1.0) - p))


def _joined(rows: DataFrame, per_tenant: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(per_tenant) if small else per_tenant, "tenant_id")


def fit(rows: DataFrame, features: tuple[str, ...], label: str, spec: Trees = Trees()) -> DataFrame:
    """Ensembles of `rows` (tenant_id, features, label 0 or 1): tenant_id, base, cuts, trees array of (splits, leaves).

    Null and NaN features count as smallest. Rows without a label or tenant do not count; a tenant with one class gets a
    finite base all the same; repeated rows count each; an empty table gives no rows.
    """
    known = rows.where(F.col(label).isNotNull() & F.col("tenant_id").isNotNull())
    ones = F.sum(F.col(label).cast("double"))
    base = F.log((ones + 0.5) / (F.count(F.lit(1)) - ones + 0.5))
    model = settle(known.groupBy("tenant_id").agg(base.alias("base"), F.count(F.lit(1)).alias("n")).join(feature_cuts(known, features, spec.bins), "tenant_id", "left"))
    small = model.count() <= BROADCAST_TENANTS
    state = settle(_joined(known, model, small).select(
        "tenant_id", "n", _bins(features).alias("x"), F.col(label).cast("double").alias("y"), F.col("base").alias("margin")))
    entries = [_entries(_alone(state.where(F.col("n") <= TOGETHER), spec))]
    large = state.where(F.col("n") > TOGETHER)
    if model.where(F.col("n") > TOGETHER).count():
        entries += _by_levels(large, model.where(F.col("n") > TOGETHER), small, spec)
    of_round = F.map_from_entries(F.collect_list("entry")).alias("of_round")
    trees = reduce(DataFrame.unionByName, entries).groupBy("tenant_id").agg(of_round)
    in_order = F.array(*[F.col("of_round")[F.lit(nth)] for nth in range(spec.rounds)])
    return settle(_joined(model, trees, small).select("tenant_id", "base", "cuts", in_order.alias("trees")))


def _alone(rows: DataFrame, spec: Trees) -> DataFrame:
    """Trees of tenants whose rows fit into a task, a tenant a group: tenant_id, nth, node, and feature and bin of a cut or a leaf's value."""
    def run(table: pd.DataFrame) -> pd.DataFrame:
        found = grow(np.array(table["x"].tolist(), dtype=np.int64), table["y"].to_numpy(), float(table["margin"].iloc[0]), spec)
        out = pd.DataFrame(found, columns=["nth", "node", "feature", "bin", "value"], dtype=object)
        return out.assign(tenant_id=table["tenant_id"].iloc[0])[["tenant_id", *out.columns]]

    return rows.select("tenant_id", "x", "y", "margin").groupBy("tenant_id").applyInPandas(
        run, "tenant_id long, nth int, node int, feature int, bin int, value double")


def grow(x: np.ndarray, y: np.ndarray, base: float, spec: Trees) -> list[tuple]:
    """The trees of one tenant's bins `x` and labels: the same sums, gains and ties as `histogram` and `best_cuts` give."""
    n, k = x.shape
    width, out, margin = spec.bins + 1, [], np.full(n, base)
    for nth in range(spec.rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        weights = [np.ones(n), np.rint((p - y) * FINE), np.rint(p * (1.0 - p) * FINE)]  # integers that doubles add up exactly
        node = np.zeros(n, np.int64)
        for level in range(spec.depth):
            cell = ((node[:, None] * k + np.arange(k)) * width + x).ravel()
            shape = (2 ** level, k * width)
            left = [np.bincount(cell, np.repeat(w, k), shape[0] * shape[1]).reshape(-1, k, width).cumsum(axis=2) for w in weights]
            whole = [c[:, :1, -1:] for c in left]
            sides = [left, [a - c for a, c in zip(whole, left)], whole]
            worth = [(g / FINE) * (g / FINE) / (h / FINE + spec.ridge) for _, g, h in sides]
            gain = worth[0] + worth[1] - worth[2]
            fair = (sides[0][0] >= spec.least) & (sides[1][0] >= spec.least) & (gain > 0)
            gain = np.where(fair, gain, -1.0).reshape(shape)
            best = gain.argmax(axis=1)
            cut = gain[np.arange(shape[0]), best] > 0
            feature, at = best // width, np.where(cut, best % width, width)
            out += [(nth, 2 ** level + i, int(feature[i]), int(at[i]), None) for i in np.flatnonzero(cut)]
            if level == spec.depth - 1:
                pick = lambda c, s: np.where(cut, np.broadcast_to(c, (shape[0], k, width)).reshape(shape)[np.arange(shape[0]), best], s)
                value = [-(g / FINE) / (h / FINE + spec.ridge) * spec.rate for _, g, h in sides]
                total = value[2].reshape(-1)
                leaves = np.stack([pick(value[0], total), pick(value[1], total)], axis=1).ravel()
            node = node * 2 + (x[np.arange(n), feature[node]] > at[node])
        out += [(nth, 2 ** spec.depth + i, None, None, float(leaves[i])) for i in np.unique(node)]
        margin = margin + leaves[node]
    return out


def _entries(flat: DataFrame) -> DataFrame:
    """Flat trees as entries (nth, tree) per tenant."""
    cut = F.when(F.col("feature").isNotNull(), F.struct("node", F.struct("feature", "bin")))
    leaf = F.when(F.col("value").isNotNull(), F.struct("node", "value"))
    tree = F.struct(F.map_from_entries(F.collect_list(cut)).alias("splits"), F.map_from_entries(F.collect_list(leaf)).alias("leaves"))
    return flat.groupBy("tenant_id", "nth").agg(tree.alias("tree")).select("tenant_id", F.struct("nth", "tree").alias("entry"))


def _by_levels(state: DataFrame, model: DataFrame, small: bool, spec: Trees) -> list[DataFrame]:
    """Trees of tenants of any size, a pass a level: entries of each round."""
    node_of = F.struct("feature", "bin")
    grown_trees = []
    for nth in range(spec.rounds):
        tree = model.select("tenant_id", F.create_map().cast(SPLITS).alias("splits"))
        for level in range(spec.depth):
            g, h = gradients(F.col("margin"), F.col("y"))
            placed = _joined(state, tree, small).select("tenant_id", "x", _walk(F.col("x"), F.col("splits"), level).alias("node"), g.alias("g"), h.alias("h"))
            # a tenant's cells are bounded by nodes, features and bins: from here on they stay together
            cuts = best_cuts(histogram(placed).repartition("tenant_id"), spec)
            found = [F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("node", node_of)))).alias("more")]
            if level == spec.depth - 1:
                ends = F.array(*[F.struct((F.col("node") * 2 + i).alias("node"), F.col(c).alias("value")) for i, c in enumerate(("left", "right"))])
                found.append(F.map_from_entries(F.flatten(F.collect_list(ends))).alias("leaves"))
            grown = _joined(cuts.groupBy("tenant_id").agg(*found), tree, small)
            tree = settle_sizeless(grown.select("tenant_id", F.map_concat("splits", "more").alias("splits"), *[c for c in ("leaves",) if len(found) > 1]))
        reached = _walk(F.col("x"), F.col("splits"), spec.depth)
        state = settle(_joined(state, tree, small).select(
            "tenant_id", "x", "y", (F.col("margin") + F.coalesce(F.col("leaves")[reached], F.lit(0.0))).alias("margin")))
        grown_trees.append(tree.select("tenant_id", F.struct(F.lit(nth).alias("nth"), F.struct("splits", "leaves").alias("tree")).alias("entry")))
    return grown_trees


def score(rows: DataFrame, model: DataFrame, features: tuple[str, ...], spec: Trees = Trees()) -> DataFrame:
    """`rows` of the tenants that have an ensemble, with `score`, the chance of label 1."""
    small = model.count() <= BROADCAST_TENANTS
    x = F.col("__x")
    add = lambda m, t: m + F.coalesce(t["leaves"][_walk(x, t["splits"], spec.depth)], F.lit(0.0))
    placed = _joined(rows, model, small).withColumn("__x", _bins(features))
    margin = F.aggregate(F.col("trees"), F.col("base"), add)
    return placed.select(*rows.columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("score"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
