"""Connected components of links, by smallest reachable label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arledger.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids in ``links`` (columns a, b); component is the smallest id.

    Every round takes the smallest label among the neighbours and then the label of that
    label, so paths halve each round. Labels and links stay in tables; only the number of
    changes comes to the driver. A vertex with very many links is a hot join key, which the
    planner can split, and a minimum that is taken before the shuffle.
    """
    edges = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b")
        .distinct()
    )
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select(
        "id", F.least("id", "near").alias("component")
    ))
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("new")
        )
        roots = labels.select(F.col("id").alias("new"), F.col("component").alias("root"))
        moved = stored(
            lower.join(roots, "new").select("id", "old", F.least("new", "root").alias("component"))
        )
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels
