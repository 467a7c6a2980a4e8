"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import settle


def components(links: DataFrame) -> DataFrame:
    """node, label for every end of a link (a, b): the smallest node that links lead to.

    Each step gives a node the smallest of itself and its neighbours and replaces the links by
    those between the given labels, until none is left. Minima combine before the shuffle, so a
    node with most of the links is no heavier than others. No links: no rows.
    """
    links = settle(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        step = settle(
            ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")),
            "labels",
        )
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("onward"))
            labels = settle(
                labels.join(onward, "label", "left").select("node", F.coalesce("onward", "label").alias("label")), "labels"
            )
        links = settle(
            links.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct(),
            "links",
        )
        if links.isEmpty():
            return labels
