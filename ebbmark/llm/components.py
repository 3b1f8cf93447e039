"""Connected components of a graph given as pairs, by label propagation with pointer jumping.

Each round, every node takes the least label among itself and its neighbours, then the label of that label.
Only aggregates with map-side combination and plain joins are used, so a hub is split like any skewed join,
and nothing is collected but one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ebbmark.session import stored


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label`` with the least node of its component, for every node that occurs in a pair."""
    both = stored(pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
                  .union(pairs.select(F.col(b).alias("x"), F.col(a).alias("y")))
                  .where("x IS NOT NULL AND y IS NOT NULL").distinct(), "component-links")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")),
                    "component-labels")
    while True:
        # The label of each neighbour, gathered at x; then hook x's own label to the least of them.
        near = both.join(labels, both.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("seen"))
        own = labels.join(near, "node")
        lower = own.select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        hooked = (own.where("seen < label").groupBy(F.col("label").alias("node")).agg(F.min("seen").alias("lower")))
        moved = lower.join(hooked, "node", "left").select(
            "node", F.least(F.col("label"), F.coalesce("lower", "label")).alias("label"), "old")
        parent = moved.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = stored(moved.join(parent, "label", "left").select(
            "node", F.least(F.col("label"), F.coalesce("above", "label")).alias("label"), "old"), "component-labels")
        if after.where("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
