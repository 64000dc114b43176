"""Connected components of a table of links, by contracting stars round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of ``links`` (a, b) can reach.

    Every round points each node to its smallest neighbour, follows these pointers twice, and keeps the links
    between different stars. Rounds grow with the logarithm of a component's size; each is written.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                     .withColumn("label", F.col("node")), "labels")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("p")).select(
            F.col("a").alias("label"), F.least("a", "p").alias("p")), "parents")
        up = parent.select(F.col("label").alias("p"), F.col("p").alias("pp"))
        for _ in range(2):
            parent = parent.join(up, "p", "left").select("label", F.coalesce("pp", "p").alias("p"))
        parent = written(parent, "parents")
        labels = written(labels.join(parent, "label", "left").select("node", F.coalesce("p", "label").alias("label")),
                         "labels")
        a, b = (parent.select(F.col("label").alias(end), F.col("p").alias(f"p{end}")) for end in "ab")
        links = written(links.join(a, "a").join(b, "b").filter("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return labels
