"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) of all nodes of ``edges`` (u, v: long).

    Every round takes the smallest label among the neighbours and then that label's own label, so chains halve.
    Labels are written each round; nothing but a count of changes reaches the driver.
    """
    both = stored(edges.where("u <> v").select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        )
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parent = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = stored(
            least.join(parent, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels",
        )
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
