"""Connected components of a graph given as a table of links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import checkpointed


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the least node reachable.

    Alternating large-star and small-star steps: each node's larger neighbours
    move to its least neighbour, then each node and its smaller neighbours do,
    until all are stars, in a number of rounds that grows with the logarithm of
    a component's size.  Minima are partial sums on the map side, and are
    written to the shared folder before they are joined to the links again, so
    that Spark can split the links of a node that has very many.
    """
    x, y = F.least(a, b), F.greatest(a, b)
    links = checkpointed(links.select(y.alias("hi"), x.alias("lo")).where("hi > lo").distinct())
    for _ in range(max_rounds):
        if _settled(links):
            break
        both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = checkpointed(both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")).withColumn("least", F.least("node", "least")))
        # large star: from node hi, neighbours above it hang on the least one
        large = links.join(least, links.lo == least.node).select(F.col("hi"), F.col("least").alias("lo")).distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")))
        # small star: node and its smaller neighbours hang on the least of them
        moved = large.join(least, large.hi == least.node)
        small = moved.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi > lo").union(least.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
        links = checkpointed(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars already: each node that hangs does so on one node, which hangs on none."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("lo", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or up = 1 and down = 1").isEmpty()
