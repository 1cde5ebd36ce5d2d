"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node it can reach.

    ``edges`` has the columns a and b.  Each round lets every node follow its smallest neighbour twice and
    contracts the edges; pointers between two contracted nodes stay edges, so nothing is separated.  Rounds are
    joins and minima over the table of edges, which shrinks; each is landed in the shared folder.  Empty edges
    give no rows; loops and repeated edges do not matter; edges with a null end are left out.
    """
    edges = landed(
        edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    labels = landed(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")),
        "labels",
    )
    edges = edges.where("a < b")
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("low")).union(edges.select("b", "a"))
        low = landed(ends.groupBy("node").agg(F.min("low").alias("low")), "low")
        again = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        step = landed(
            low.join(again, "low").select("node", F.col("lower").alias("to")), "step"
        )
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("x"), F.col("b_to").alias("y"))
        left = step.select("to").distinct().join(step.withColumnRenamed("to", "next"), F.col("to") == F.col("node"))
        kept = moved.union(left.select("to", "next")).where("x <> y")
        labels = landed(
            labels.join(step.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "labels",
        )
        edges = landed(
            kept.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    return labels
