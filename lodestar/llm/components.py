"""Connected components of an edge table by alternating stars, all as joins and
aggregations; tables are written between rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): the least node reachable."""
    edges = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        # done when every node has one edge, to a node that has none
        open_ = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() \
            + new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = new
        if not open_:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
