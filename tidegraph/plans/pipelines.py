"""The three pipelines: influential users of one graph, balanced parts, and seeds chosen per part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade, components, edges as E, influence, pagerank, partition
from ..operators.iterate import checkpointed
from ..options import RankOptions, SpreadOptions, Weights


def influential(edges: DataFrame, k: int = 3, mode: str = "min_rank") -> DataFrame:
    """(pos, id): degrees, scores, power, candidates, seeds."""
    edges = checkpointed(E.valid(edges))
    return influence.seeds(edges, checkpointed(influence.power(edges)), k, mode)


def balanced(edges: DataFrame, k: int, dense: bool = False) -> DataFrame:
    """(part, node): components, trees, longest first."""
    ids = E.dense_vertices(edges) if dense else E.vertices(edges)
    comps = checkpointed(components.scc(edges, ids))
    return partition.cac_partition(comps, components.cac(components.dag(edges, comps), comps), k)


def candidate_pool(sub: DataFrame, parts: DataFrame, k: int, rank: RankOptions) -> DataFrame:
    return pagerank.top(pagerank.pagerank(sub, rank), parts, k)


def spread_metrics(edges: DataFrame, parts: DataFrame, weights: Weights, rank: RankOptions) -> DataFrame:
    """What a run over split parts reports of each: n_edges kept, n_ghosts, n_ranked vertices, PageRank's n_steps and whether it converged. A part without edges has nothing to rank."""
    sub = checkpointed(E.subgraph(E.weighted(edges, weights), parts))
    every = parts.select("part").distinct().join(E.subgraph_stats(sub, parts), "part", "left").fillna(0)
    ended = pagerank.convergence(sub, rank).withColumnRenamed("n_nodes", "n_ranked")
    return every.join(ended, "part", "left").fillna(0, ["n_ranked", "n_steps"]).fillna(False, ["converged"])


def spread_seeds(edges: DataFrame, parts: DataFrame, weights: Weights, rank: RankOptions, spread: SpreadOptions) -> tuple[DataFrame, DataFrame]:
    """Seeds (pos, id, spread) and one row total, mean_spread. Scope `partition`: seeds are compared on the first part's edges, and spread in each
    part counts its seeds anew; `global`: both on the whole graph."""
    edges = E.weighted(edges, weights)
    one = parts.select(F.lit(0).alias("part"), "node").distinct()
    by = parts if spread.scope == "partition" else one
    sub = checkpointed(E.subgraph(edges, by))
    pool = candidate_pool(sub, by, spread.k, rank)
    first = sub.agg(F.min("part")).first()[0]
    chosen = checkpointed(cascade.greedy(sub.filter(F.col("part") == first), pool, spread.k))
    runs = cascade.cascaded(sub, chosen, by, spread.trials, spread.seed)
    return chosen, cascade.total(runs, spread.trials)
