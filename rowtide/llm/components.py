"""Connected components of links, by alternating stars, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.session import written


def _with_least(edges: DataFrame, by: str, of: str) -> DataFrame:
    """Each edge with the least neighbour of its first node; counted before the shuffle."""
    least = edges.groupBy(by).agg(F.min(of).alias("least"))
    return edges.join(least, by)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node it is linked with over any number of links.

    Every round hangs neighbours on their least neighbour, first the larger ones, then the
    smaller ones, until nothing changes. Rounds are written, so that lineage stays short.
    Nodes without links do not appear; links to oneself and nulls are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(edges.filter("u > v").distinct(), "links")
    seen = None
    while True:
        # Both directions; every larger neighbour of u goes to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()
        # u and its smaller neighbours go to the least of them.
        small = _with_least(large, "u", "v").select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
        edges = written(small.select("e.*").filter("u > v").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
