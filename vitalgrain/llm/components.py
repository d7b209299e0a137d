"""Connected components by repeated minimum labels with pointer jumping, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrain.llm.common import materialize


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, label) for every end of an edge (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours by a pre-aggregated minimum and then the label
    of that label; a round is written to ``at``, so lineage stays short. A hub's edges are summed up
    before they are shuffled, and its label is looked up by a join whose large keys can be split.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{at}/edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{at}/labels-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(near.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), f"{at}/labels-{step}")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
