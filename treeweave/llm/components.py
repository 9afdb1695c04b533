"""Connected components of an edge table, by joins: no link and no component is ever gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): the root is the component's smallest node.

    Each round takes the smallest label among the neighbours and then that label's own label, so that long chains
    shorten by halves. Rounds are staged tables; the last one changes nothing.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        seen = staged(labels.join(near, "a").select("a", F.col("l").alias("was"), F.least("l", "m").alias("l")), "labels")
        jumps = seen.select(F.col("a").alias("l"), F.col("l").alias("further"))
        labels = staged(seen.join(jumps, "l").select("a", F.col("further").alias("l"), (F.col("further") != F.col("was")).alias("changed")), "labels")
        if not labels.filter("changed").limit(1).count():
            return labels.select(F.col("a").alias("node"), F.col("l").alias("root"))
        labels = labels.drop("changed")
