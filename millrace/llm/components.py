"""Connected components of a link table by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable.

    Each round hands every id the least label among its neighbours and itself, then
    replaces the label by that label's own label, so long chains shorten by half. The
    labels are written to the shared folder each round; only a count of changes
    reaches the driver. An empty link table gives no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stored(both)
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.alias("x").join(near, F.col("x.id") == F.col("a")).select("x.id", F.col("x.label").alias("old"), F.least("x.label", "near").alias("label"))
        up = labels.select(F.col("id").alias("_i"), F.col("label").alias("_up"))
        new = stored(lower.join(up, F.col("label") == F.col("_i"), "left").select("id", "old", F.least("label", "_up").alias("label")))
        changed = new.where("old != label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
