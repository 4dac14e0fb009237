"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label: the smallest node of its component, for every node that has a link.

    Every round takes the smallest label over a node's links and then the label of that label, so long chains halve; the
    rounds end when no label changes. Minima are summed up before they are shuffled. Each round is a table in the shared
    folder."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.write_shared(both, "links")
    labels = common.write_shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        new = common.write_shared(nearer.join(jump, "label").select("node", F.least("label", "jumped").alias("label"), (F.least("label", "jumped") < F.col("before")).alias("changed")), "labels")
        common.release(labels)
        labels = new
        if not new.where("changed").limit(1).count():
            common.release(both)
            return labels.drop("changed")
