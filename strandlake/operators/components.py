"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component`` (least node id in it) for every node of an edge between two different nodes.

    Labels fall to the least label among neighbours, then jump to their label's label, until none
    changes; the number of rounds grows with the logarithm of a component's diameter. Each round's
    labels are written to the shared folder, so the plan stays short and nothing is lost with an
    executor. Edges with a null end are left out.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b"))
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        fallen = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = fallen.join(target, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        rounds = materialize(jumped, "labels")
        labels = rounds.select("node", "component")
        if rounds.where(F.col("was") != F.col("component")).isEmpty():
            return labels
