"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges(src, dst); the component is its smallest id.

    Every round takes the smallest label among a vertex's neighbours (summed
    before the shuffle, so a hub costs no more than another vertex) and then
    follows the label's own label, which halves the distance left.  It ends
    when a round changes nothing.
    """
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("m"))
        step = materialize(
            labels.join(near, labels.id == near.src, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        )
        jump = step.select(F.col("id").alias("at"), F.col("component").alias("further"))
        new = materialize(
            step.join(jump, step.component == jump.at, "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "old")
        )
        changed = new.where("component <> old").limit(1).count()
        discard(labels, step)
        labels = new.select("id", "component")
        if not changed:
            discard(both)
            return labels
