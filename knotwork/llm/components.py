"""Connected components of an edge table by repeated least-neighbour steps with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in an edge the least id reachable from it.

    Each round gives every id the least label among its own, its neighbours'
    and its label's label, so chains shrink by halves. Labels are written to
    the shared folder after each round; only the number of changes comes to
    the driver. Every shuffle but the label's is by an id's links, which
    aggregate before they move.
    """
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).where("id <> to")
    both = W.stage_table(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "edges")
    labels = W.stage_table(both.groupBy("id").agg(F.min("to").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "to"}), "to").select("id", "component")
        best = near.unionByName(labels).groupBy("id").agg(F.min("component").alias("component"))
        up = best.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = best.join(up, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component"))
        new = W.stage_table(new, "labels")
        changed = new.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        W.drop_stage(labels)
        labels = new
        if not changed:
            W.drop_stage(both)
            return labels
