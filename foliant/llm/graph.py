"""Connected components of an undirected graph, distributed.

Alternating large-star and small-star rounds (Kiveris et al., 2014) on
DataFrames. Each round is written to the shared folder, so a lost executor costs
no more than that round; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a < b. Large: every node's greater neighbours are tied
    to the least of it and its neighbours; small: it and its lesser ones."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        out = tied.filter("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = tied.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", what: str = "components") -> DataFrame:
    """(node, component) of every node with an edge to another; the component is
    named by its least node. Nulls, loops and repeated edges are ignored."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct(), what)
    mark = None
    while True:
        now = written(_star(_star(now, True), False), what)
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark:
            break
        mark = seen
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(now.select("a").distinct().select("a", F.col("a").alias("component")))
