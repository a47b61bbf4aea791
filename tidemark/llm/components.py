"""Connected components of a graph of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """node and label (the smallest node it can reach) of every node of ``links`` (a, b: longs).

    Each round hooks labels onto smaller labels of neighbours and halves the paths of labels, so the number of rounds
    grows with the logarithm of the longest path. Nothing of the graph reaches the driver but whether a label moved. ``most``: files of a
    table at most.
    """
    links = links.filter("a <> b")
    both = scratch.table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", most)
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels", most)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").select(F.col("a").alias("node"), F.lit(None).cast("long").alias("label"), F.col("near").alias("low"))
        met = labels.select("node", "label", F.col("label").alias("low")).union(near).groupBy("node").agg(F.max("label").alias("label"), F.min("low").alias("low"))
        # a label also moves to the least that any of its nodes has met
        moves = met.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("to"))
        moved = met.join(moves, met["label"] == moves["root"]).select("node", "label", F.least("low", "to").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        to = F.least("next", F.coalesce("far", "next"))
        labels, seen = scratch.observed(moved.join(jump, "next", "left").select("node", to.alias("label"), (F.col("label") != to).alias("changed")), "labels", most, changed=F.max("changed"))
        labels = labels.select("node", "label")
        scratch.settled(links.sparkSession)
        if not seen["changed"]:
            return labels
