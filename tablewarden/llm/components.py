"""Connected components of a graph of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node it reaches) for links ``a``, ``b``; nodes without links are left out.

    Each round takes every label to the smallest label that one of its members, or the node of that name, sees
    among its neighbours, and from there one step further. So a region moves as a whole, chains of labels shrink
    by more than half, and rounds go on until nothing moves: then neighbours agree. Labels are written each
    round; only a count goes to the driver.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        # each node speaks for its label, and for itself where it is one
        own = F.struct(F.col("label").alias("of"), F.lit(True).alias("used"))
        itself = F.struct(F.col("node").alias("of"), F.lit(False).alias("used"))
        told = seen.select(F.explode(F.array(own, itself)).alias("t"), "low")
        hooks = told.groupBy("t.of").agg(F.min("low").alias("to"), F.max("t.used").alias("used"))
        hooks = stored(hooks.where("used").select("of", "to"))
        further = hooks.select(F.col("of").alias("to"), F.col("to").alias("further"))
        ends = hooks.join(further, "to", "left").select(F.col("of").alias("label"), F.coalesce("further", "to").alias("end"))
        if not hooks.where("of <> to").limit(1).count():
            return labels
        labels = stored(labels.join(ends, "label").select("node", F.col("end").alias("label")))
