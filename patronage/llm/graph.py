"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node on a link (a, b); the root is some node of its component, the same for all of it.

    Contraction: every node points to the least of itself and its neighbours, the
    pointers are followed once more, links are carried over to the nodes pointed at
    and those that became loops go. A component with a link loses at least one
    node each round, so the loop ends when no link is left, whatever the shape. What
    is joined on a hub is a written table on either side, which lets Spark split a
    hub's rows. Rows with a null end are no links.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), "links")
    rounds = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to"), "low")
        further = low.select(F.col("node").alias("to"), F.col("to").alias("then"))
        low = stored(low.join(further, "to").select("node", F.col("then").alias("to")), "low")
        rounds.append(low)
        at_a = low.select(F.col("node").alias("a"), F.col("to").alias("u"))
        at_b = low.select(F.col("node").alias("b"), F.col("to").alias("v"))
        moved = now.join(at_a, "a").join(at_b, "b").where("u <> v")
        now = stored(moved.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    found = rounds[0]
    for low in rounds[1:]:
        then = low.select(F.col("node").alias("to"), F.col("to").alias("then"))
        found = found.join(then, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    return found.select("node", F.col("to").alias("root"))
