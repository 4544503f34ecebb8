"""Edge tables without iteration: (src, dest, likes, shares, comments, occ), where occ numbers equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import influence, weight
from ..functions.ranks import placed
from ..options import Weights
from .iterate import checkpointed

KEY = ["src", "dest", "likes", "shares", "comments"]


def with_occ(edges: DataFrame) -> DataFrame:
    """Numbers equal rows from 1: counted first, so that many copies of one edge are one row in the shuffle."""
    counted = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("occ"))


def valid(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("src") >= 0) & (F.col("dest") >= 0))


def quality(edges: DataFrame) -> DataFrame:
    """One row: how many edges, with negative ids, with a negative weight, loops."""
    return edges.agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_if((F.col("src") < 0) | (F.col("dest") < 0)).alias("n_bad_ids"),
        F.count_if((F.col("likes") < 0) | (F.col("shares") < 0) | (F.col("comments") < 0)).alias("n_negative"),
        F.count_if(F.col("src") == F.col("dest")).alias("n_loops"),
    )


def pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dest").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dest")).alias("id")).distinct()


def dense_vertices(edges: DataFrame) -> DataFrame:
    """0 to the largest id; gaps are isolated vertices."""
    top = edges.agg(F.max(F.greatest("src", "dest"))).first()[0]
    return edges.sparkSession.range(0, 0 if top is None else top + 1).select("id")


def vertex_index(edges: DataFrame) -> DataFrame:
    """id and its place among all ids, from 0."""
    return placed(vertices(edges), "id", cut=checkpointed, name="idx")


def weighted(edges: DataFrame, w: Weights) -> DataFrame:
    return edges.withColumn("w", weight(w))


def degrees(edges: DataFrame) -> DataFrame:
    """followers (in) and followees (out) over distinct pairs, loops included."""
    p = pairs(edges)
    ends = p.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dest").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("id").agg(F.sum("i").alias("followers"), F.sum("o").alias("followees"))


def psi(edges: DataFrame) -> DataFrame:
    """1 / followees of src on every distinct edge."""
    out = degrees(edges).select(F.col("id").alias("src"), "followees")
    return pairs(edges).join(out, "src").select("src", "dest", (F.lit(1.0) / F.col("followees")).alias("psi"))


def influence_score(edges: DataFrame, d: float = 0.85) -> DataFrame:
    """A vertex's psi sums to 1 if it has followees at all, so the score needs degrees only."""
    deg = degrees(edges)
    n = deg.agg(F.count(F.lit(1)).alias("n"))
    score = influence(F.col("followers"), (F.col("followees") > 0).cast("int"), F.col("n"), d)
    return deg.crossJoin(F.broadcast(n)).select("id", score.alias("score"))  # n is one row


def subgraph(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Each part's edges with an end in it. An edge is listed once for each part that it touches; rows that are equal in all columns, which
    there are none of where occ numbers them, count as one."""
    of = parts.groupBy("node").agg(F.collect_set("part").alias("_parts"))
    at = lambda end: of.withColumnsRenamed({"node": end, "_parts": f"_{end}"})
    both = edges.join(at("src"), "src", "left").join(at("dest"), "dest", "left")
    touched = F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.expr("array()")) for c in ("_src", "_dest")]))
    sub = both.select(F.explode(touched).alias("part"), *edges.columns)
    return sub if "occ" in edges.columns else sub.distinct()


def ghosts(sub: DataFrame, parts: DataFrame) -> DataFrame:
    """Vertices that a part's edges touch but that aren't its own."""
    ends = sub.select("part", F.explode(F.array("src", "dest")).alias("node")).distinct()
    return ends.join(parts, ["part", "node"], "left_anti")


def subgraph_stats(sub: DataFrame, parts: DataFrame) -> DataFrame:
    kept = sub.groupBy("part").agg(F.count(F.lit(1)).alias("n_edges"))
    out = ghosts(sub, parts).groupBy("part").agg(F.count(F.lit(1)).alias("n_ghosts"))
    return kept.join(out, "part", "left").select("part", "n_edges", F.coalesce("n_ghosts", F.lit(0)).alias("n_ghosts"))
