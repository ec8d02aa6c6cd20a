"""Connected components of links between numbered nodes, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``a, b`` to ``node, component``: the smallest node that each linked node reaches.

    In a round every node points to its smallest neighbour if that is smaller than itself, and then to where that one
    points. Links are moved to those places; links within a place go, equal ones become one, so what is left shrinks
    from round to round. Neighbours are pre-aggregated in the map tasks; a node with very many links is split by the
    adaptive skew join. Every round is written out, so a lost executor costs part of one round.
    """
    plain = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    open_ = materialise(plain.union(plain.select("b", "a")).distinct())
    labels = materialise(open_.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    while not open_.isEmpty():
        to = materialise(open_.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        step = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
        to = materialise(to.join(step, "p").select("a", F.col("q").alias("p")))
        labels = materialise(
            labels.join(to.select(F.col("a").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        )
        moved = open_.join(to, "a").select("b", F.col("p").alias("x")).join(to.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        open_ = materialise(moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return labels
