"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of `links(a, b)` with the smallest node it can reach.

    Each round gives a node the smallest label among its neighbours and its
    own, then the label of that label; the rounds end when no label changes.
    Rounds are written to the shared folder.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        # A label is a node itself: go on to what that node was given.
        jump = met.select(F.col("node").alias("now"), F.col("now").alias("next"))
        labels = cut_lineage(met.join(jump, "now").select(
            "node", F.col("next").alias("component"), (F.col("next") < F.col("was")).alias("moved")), "labels")
    return labels.select("node", "component")
