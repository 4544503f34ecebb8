"""Interaction graphs made of the whole order tables, by integer arithmetic only: `link` (an edge an order), bipartite `trade` (one or two an item), dense `dense`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import placed
from ..operators.edges import with_occ
from ..operators.iterate import checkpointed

_WEIGHTS = ["cast((o_orderkey div 8) % 6 as int) as likes", "cast((o_orderkey div 48) % 4 as int) as shares", "cast((o_orderkey div 192) % 3 as int) as comments"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_cust"))  # one row
    rows = _t(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return with_occ(rows.selectExpr("o_custkey as src", "(o_custkey * 31 + o_orderkey * 17) % n_cust as dest", *_WEIGHTS))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.selectExpr("o_custkey as c", "1000000 + l_suppkey as s", "cast(l_quantity as int) as likes", "l_linenumber as shares", "l_returnflag = 'R' as back")
    there = rows.select(F.col("c").alias("src"), F.col("s").alias("dest"), "likes", "shares", F.lit(0).alias("comments"))
    back = rows.filter("back").select(F.col("s").alias("src"), F.col("c").alias("dest"), "likes", "shares", F.lit(1).alias("comments"))
    return with_occ(there.unionByName(back))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's customer follows that of the order before it, by date and key."""
    orders = placed(_t(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey"), "o_orderdate", "o_orderkey", cut=checkpointed)
    before = orders.select((F.col("place") + 1).alias("place"), F.col("o_custkey").alias("src"))
    return with_occ(orders.join(before, "place").selectExpr("src", "o_custkey as dest", *_WEIGHTS))


def thirds(edges: DataFrame) -> DataFrame:
    """(part, node): id modulo 3."""
    ids = edges.select(F.explode(F.array("src", "dest")).alias("node")).distinct()
    return ids.select((F.col("node") % 3).cast("int").alias("part"), "node")
