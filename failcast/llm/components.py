"""Connected components of a table of links, by alternating large-star and small-star steps.

Links never reach the driver. Each step finds a node's smallest neighbour by a combined
aggregate and joins it back to the links; the smallest neighbours are written first, so
that both sides of the join are shuffled and a hub's links can be split (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.scratch import discard, materialize


def _settled(links: DataFrame) -> bool:
    """Whether every node is tied to one other at most, and that one to none: it is the smallest node reached then."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("tied")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("tied")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("tied").alias("ties"), F.min("tied").alias("least"))
    return nodes.where("ties > 1 OR (ties = 1 AND least = 0)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, either order, repeats and loops allowed) -> node, component.

    One row per node that has a link to another; component is the smallest node reached.
    Rows with a null end are ignored; without links the result is empty.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large_star")
        # each larger neighbour is tied to the smallest one
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionByName(now.join(least, "u").select("u", F.col("m").alias("v")).where("u <> v")).distinct(), "links")
        least_2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small_star")
        small = large.join(least_2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(least_2.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(now, least, large, least_2)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
