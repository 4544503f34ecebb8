"""Influence power, seed candidates and seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import influence
from ..functions.ranks import placed
from . import kernels as K
from .components import dag, levels, scc
from .edges import degrees, influence_score, pairs, vertex_index
from .iterate import checkpointed
from . import blocks as B
from .reach import _named, bfs, closure, held_graph

#: Components that a task's matrix of reach bits covers at a time, and its largest height: 26 MB.
BLOCK, MAX_COMPONENTS = 1024, 200_000


def power_parts(edges: DataFrame, max_edges: int = K.MAX_EDGES, max_components: int = MAX_COMPONENTS) -> DataFrame:
    """(id, followers_sum, sources): over all that id reaches, itself included, the summed followers and how many have followees; exact integers.

    Up to max_components components and max_edges links the DAG is sent to all workers, each of which sums over blocks of targets; beyond,
    the closure of the DAG is joined with the components' own sums."""
    comps = checkpointed(scc(edges, max_edges=max_edges))
    links = checkpointed(dag(edges, comps))
    own = checkpointed(degrees(edges).join(comps, "id").groupBy("scc").agg(F.sum("followers").alias("f"), F.sum((F.col("followees") > 0).cast("int")).alias("s")))
    if own.count() <= max_components and links.limit(max_edges + 1).count() <= max_edges:
        values, edge, lv = own.toPandas().sort_values("scc"), links.toPandas(), levels(links, comps).toPandas().sort_values("scc")
        names = values.scc.to_numpy()
        s, d = np.searchsorted(names, edge.cu.to_numpy(dtype=np.int64)), np.searchsorted(names, edge.cv.to_numpy(dtype=np.int64))
        held = edges.sparkSession.sparkContext.broadcast((values[["f", "s"]].to_numpy(dtype=np.int64), s, d, lv.level.to_numpy(), names))
        spark = edges.sparkSession
        blocks = max(1, -(-len(names) // BLOCK))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            val, src, dest, level, all_names = held.value
            for pdf in parts:
                for b in pdf.id:
                    got = K.reach_sums(np.arange(b * BLOCK, min((b + 1) * BLOCK, len(all_names))), val, src, dest, level)
                    keep = np.flatnonzero(got.any(axis=1))
                    yield pd.DataFrame({"scc": all_names[keep], "f": got[keep, 0], "s": got[keep, 1]})

        per = spark.range(0, blocks, 1, min(blocks, 4096)).mapInPandas(run, "scc long, f long, s long")
    else:
        far = closure(links, comps.select("scc").distinct())
        per = far.join(own, F.col("cv") == F.col("scc")).select(F.col("cu").alias("scc"), "f", "s")
    sums = per.groupBy("scc").agg(F.sum("f").alias("followers_sum"), F.sum("s").alias("sources"))
    return comps.join(sums, "scc", "left").select("id", F.coalesce("followers_sum", F.lit(0)).alias("followers_sum"), F.coalesce("sources", F.lit(0)).alias("sources"))


def power(edges: DataFrame, d: float = 0.85, **options) -> DataFrame:
    """(id, idx, power): the summed influence score of all that id reaches."""
    parts = checkpointed(power_parts(edges, **options))
    n = parts.count()
    return parts.join(vertex_index(edges), "id").select("id", "idx", influence(F.col("followers_sum"), F.col("sources"), F.lit(n), d).alias("power"))


def candidates(powers: DataFrame) -> DataFrame:
    """A fifth of the vertices (one at least) by power, ties to the larger index."""
    ranked = placed(powers.withColumn("_p", F.round("power", 10)), F.desc("_p"), F.desc("idx"), cut=checkpointed).drop("_p")
    return ranked.filter(F.col("place") < max(1, powers.count() // 5)).drop("place")


def ranking(scores: DataFrame, by: str = "score") -> DataFrame:
    """Place 1 for the highest score; ties to the larger id."""
    ranked = placed(scores.select("id", by, F.round(by, 10).alias("_s")), F.desc("_s"), F.desc("id"), cut=checkpointed)
    return ranked.select("id", by, (F.col("place") + 1).alias("place"))


def _reached(links: B.Blocks, names: B.Names, root: int) -> np.ndarray:
    seen, at = np.zeros(len(names), np.uint8), names.places(np.zeros(1, np.int64), np.array([root]))
    seen[at[0][at[1]]] = 1
    for new in links.spread(seen.copy()):
        seen |= new
    return names.ids[seen > 0]


def seeds(edges: DataFrame, powers: DataFrame, k: int = 3, mode: str = "min_rank") -> DataFrame:
    """(pos, id): k rounds; each takes the candidate whose power, less the scores of seeds that it reaches and 1e-9 x index, is least (min_rank)
    or greatest (max_rank); ties to the smaller index. Only who reaches a seed is looked for, back from each as it is chosen."""
    if k < 1 or mode not in ("min_rank", "max_rank"):
        raise ValueError("k must be 1 or more, mode min_rank or max_rank")
    pool, taken, spark = checkpointed(candidates(powers).withColumn("gone", F.lit(0.0))), [], edges.sparkSession
    back = checkpointed(pairs(edges).select(F.col("dest").alias("src"), F.col("src").alias("dest")))
    score, graph = checkpointed(influence_score(edges)), held_graph(back, K.MAX_EDGES)
    rows, names = (None, None) if graph else _named(back)
    links = B.Blocks(rows, names) if names else None
    for pos in range(1, k + 1):
        rank = F.round(F.col("power") - F.col("gone") - F.col("idx") * 1e-9, 10)
        left = pool.filter(~F.col("id").isin([i for _, i in taken])) if taken else pool
        best = left.select("id", "idx", rank.alias("rank")).orderBy(F.col("rank") if mode == "min_rank" else F.desc("rank"), "idx").first()
        if best is None:
            break
        taken.append((pos, best["id"]))
        if pos < k:
            own = score.filter(F.col("id") == best["id"]).first()["score"]
            if links:
                reach = B.table(spark, "id long", id=_reached(links, names, best["id"]))
            else:
                reach = bfs(back, spark.createDataFrame([(best["id"],)], "id long"), graph=graph).select(F.col("node").alias("id"))
            reach = reach.withColumn("s", F.lit(own))
            pool = checkpointed(pool.join(reach, "id", "left").withColumn("gone", F.col("gone") + F.coalesce("s", F.lit(0.0))).drop("s"))
    return spark.createDataFrame(taken, "pos int, id long")
