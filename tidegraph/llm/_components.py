"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014): every round is
two aggregations with joins, edges never grow in number, and rounds are logarithmic in practice.

A hub's edges don't meet in one task: minima are taken before the shuffle too, and those of hubs are broadcast to the edges (`hubs_apart`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HUB, drop, hubs_apart, written


def _least(edges: DataFrame, total: int, hub: int) -> DataFrame:
    """edges (u, v) with m, the least of u's neighbours and itself."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return hubs_apart(edges, least, ["u"], total, hub).select("u", "v", "m")


def components(edges: DataFrame, a: str = "u", b: str = "v", hub: int = HUB) -> DataFrame:
    """(node, root): root is the smallest node of node's component; nodes without an edge aren't listed."""
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen, star = None, lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    n = edges.count()
    while True:
        both = edges.select(F.explode(F.array(star("u", "v"), star("v", "u"))).alias("e")).select("e.*")
        large = _least(both, 2 * n, hub).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, 2 * n, hub).select(F.explode(F.array(star("u", "m"), star("v", "m"))).alias("e")).select("e.*").filter("u <> v").distinct()
        last, edges = edges, written(small)
        drop(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
