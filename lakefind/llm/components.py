"""Connected components by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefind.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); equal labels mean the same component.

    Each round points every node at its smallest neighbour (ids should be
    random, such as hashes: then a fixed share of the nodes disappears per
    round), follows the pointer once more and replaces the edges by the edges
    between what is pointed at.  Only grouped minima and joins; a node with
    many edges is reduced before the shuffle.
    """
    maps = []
    edges = materialize(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("to"))
        nearest = materialize(nearest.select(F.col("a").alias("node"), F.least("a", "to").alias("to")))
        beyond = nearest.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = materialize(nearest.join(beyond, "to", "left").select(
            "node", F.coalesce("further", "to").alias("to")))
        maps.append(step)
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = materialize(edges.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0].select("node", F.col("to").alias("label"))
    for step in maps[1:]:
        later = step.select(F.col("node").alias("label"), "to")
        labels = labels.join(later, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(labels)
