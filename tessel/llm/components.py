"""Connected components of a table of links, by alternating large and small stars.

Each round sends every vertex's larger neighbours, then its smaller ones, to the least it knows; the table converges to
one star for each component.  Links stay in tables throughout, and each round's table is written to the shared folder.

A vertex of many links is one row on one side of each join, so that an adaptive plan can split the other side, and sums are
made before rows are shuffled.

Nulls: a link with a null end is dropped, as is one of a vertex with itself.  Repeated links, in either direction, count
once.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import forget, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """id and least (the smallest id that can be reached) of every vertex that has a link; ``links`` has a and b (long)."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large stars: each neighbour above a vertex is linked to the least of the vertex's neighbourhood.
        both = _both(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small stars: a vertex and its neighbours below it are linked to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(small, "links")
        stars = after.groupBy("a").count().where("count > 1").limit(1).count() == 0 and after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0
        forget(edges.sparkSession, edges)
        edges = after
        if stars:
            tips = edges.select(F.col("a").alias("id"), F.col("b").alias("least"))
            return tips.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("least")).distinct())
