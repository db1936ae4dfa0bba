"""Connected components by contraction: every node joins its smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.stage import forget, written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, label): the same label within a component, for nodes that have an edge.

    Each round keeps a join and a grouping whose hot keys are pre-aggregated or split; edges at least halve in nodes.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        parents = written(
            edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy(F.col("a").alias("child"))
            .agg(F.least(F.col("child"), F.min("b")).alias("parent")),
            "parents",
        )
        if labels is None:
            next_labels = written(parents.select(F.col("child").alias("node"), F.col("parent").alias("label")), "labels")
        else:
            next_labels = written(
                labels.join(parents, labels.label == parents.child, "left").select("node", F.coalesce("parent", "label").alias("label")), "labels"
            )
            forget(labels)
        other = parents.select(F.col("child").alias("child2"), F.col("parent").alias("parent2"))
        next_edges = written(
            edges.join(parents, edges.a == parents.child)
            .join(other, F.col("b") == F.col("child2"))
            .where("parent <> parent2")
            .select(F.col("parent").alias("a"), F.col("parent2").alias("b"))
            .distinct(),
            "edges",
        )
        forget(edges, parents)
        edges, labels = next_edges, next_labels
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    forget(edges)
    return labels
