"""Connected components of a graph given as a table of edges, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u long, v long) is connected to.

    Each round gives every node the smallest label among its neighbours, and
    then the label of that label, so that chains get shorter by half.  Labels
    stay in the shared folder; only the number of changes reaches the driver.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = kept(both.where("u != v").distinct())
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    while True:
        of_neighbours = (
            both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        )
        lower = labels.join(of_neighbours, "u").select("u", F.least("label", "m").alias("lower"), "label")
        parents = labels.select(F.col("u").alias("lower"), F.col("label").alias("above"))
        jumped = kept(
            lower.join(parents, "lower", "left").select(
                "u",
                F.least("lower", F.coalesce("above", "lower")).alias("label"),
                F.col("label").alias("before"),
            )
        )
        if jumped.where("label != before").isEmpty():
            return jumped.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = jumped.select("u", "label")
