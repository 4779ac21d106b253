"""Connected components by contraction.

Each round maps every node to its smallest neighbour, follows that mapping twice, and rewrites the
links on the images; what is left is a smaller graph. Minimums are pre-aggregated before the shuffle
and joins have unique keys on one side, so a hub with a third of all links is split by the skew join.
Tables are written to the shared folder between rounds; nothing comes to the driver but a flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long), in any order, repeats allowed. Returns node, component (the smallest node reachable) for nodes that have a link to another."""
    left = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    of = None
    while not left.isEmpty():
        low = left.select("a", "b").union(left.select("b", "a")).toDF("node", "near").groupBy("node").agg(F.min("near").alias("near"))
        low = written(low.select("node", F.least("node", "near").alias("to")), "least")
        for _ in range(2):
            onward = low.select(F.col("node").alias("to"), F.col("to").alias("further"))
            low = low.join(onward, "to").select("node", F.col("further").alias("to"))
        low = written(low, "least")
        if of is None:
            of = low.select("node", F.col("to").alias("component"))
        else:
            step = low.select(F.col("node").alias("component"), "to")
            of = written(of.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        a, b = low.toDF("a", "a2"), low.toDF("b", "b2")
        left = left.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = written(left.where("a < b").distinct(), "links")
    return of if of is not None else left.toDF("node", "component")
