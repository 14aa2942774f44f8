"""Connected components of links, by minimum labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, made, sweep


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (a, b: long): the smallest node it can reach.

    Each round takes the smallest label of the neighbours, then the label's label, so paths shorten
    by half; a node with very many links is one partial aggregate a task.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        since = made()
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = keep(step)
        jump = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = keep(step.join(jump, F.col("label") == F.col("n2"), "left").select("node", "old", F.coalesce("l2", "label").alias("label")))
        changed = new.where("label <> old").count()
        sweep(links.sparkSession, since - 1, but=1)  # the labels before and the step
        labels = new.select("node", "label")
        if not changed:
            return labels
