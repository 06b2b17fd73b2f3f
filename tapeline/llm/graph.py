"""Connected components of an edge list, as alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` (the smallest node it reaches) for every linked node.

    ``edges`` has columns ``a`` and ``b``. Each round hangs every node on the smallest
    neighbour it knows, first among larger and then among smaller neighbours; rounds end
    when every node hangs on its root. What a round hands on is a written table, so that
    no lineage grows, a lost executor repeats one step only, and both sides of each join
    are plain scans, whose skewed keys Spark can split.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = materialize(
        edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links"
    )
    while True:
        # larger neighbours move to the smallest neighbour
        both = links.union(links.select("b", "a")).toDF("a", "b")
        lowest = materialize(
            both.groupBy("a").agg(F.min("b").alias("b")).select(
                F.col("a").alias("node"), F.least("a", "b").alias("low")
            ),
            "lowest",
        )
        stars = both.where("b > a").join(lowest, F.col("a") == F.col("node"))
        stars = materialize(
            stars.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(),
            "stars",
        )
        # smaller neighbours and the node itself move to the smallest one
        lowest = materialize(
            stars.groupBy(F.col("a").alias("node")).agg(
                F.min("b").alias("low"), F.count("*").alias("n")
            ),
            "lowest",
        )
        done = lowest.where("n > 1").isEmpty()
        if done:
            # every node has one parent; it is done if no parent has a parent
            done = stars.join(lowest, F.col("b") == F.col("node"), "left_semi").isEmpty()
        if done:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        moved = stars.join(lowest, F.col("a") == F.col("node"))
        links = materialize(
            moved.where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(lowest.select(F.col("node").alias("a"), F.col("low").alias("b")))
            .distinct(),
            "links",
        )
