"""A query for each operator, over graphs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, components as C, edges as E, influence as I, pagerank as P, partition as S, reach as R
from ..operators.iterate import checkpointed
from ..options import RankOptions, SpreadOptions, Weights
from ..sources import text as T
from . import pipelines, recipes

RANK, CAST = Weights(0.1, 0.5, 0.8), Weights(0.02, 0.03, 0.05)
FIVE = RankOptions(max_iter=5, tol=None)
TRIALS, SEED, K = 20, 42, 5
_r8 = lambda c: F.round(c, 8).alias(c)


def _link(f):
    return lambda spark, sf_dir: f(checkpointed(recipes.link(spark, sf_dir)))


def _trade(f):
    return lambda spark, sf_dir: f(checkpointed(recipes.trade(spark, sf_dir)))


def _dense(f):
    return lambda spark, sf_dir: f(checkpointed(recipes.dense(spark, sf_dir)))


def _comps(f):
    def run(g: DataFrame) -> DataFrame:
        comps = checkpointed(C.scc(g))
        return f(g, comps, C.dag(g, comps))

    return _link(run)


def _sub(f, weights: Weights = RANK):
    def run(g: DataFrame) -> DataFrame:
        parts = recipes.thirds(g)
        return f(E.subgraph(E.weighted(g, weights), parts), parts)

    return _trade(run)


def _power(g: DataFrame) -> DataFrame:
    return checkpointed(I.power(g))


def _lines(g: DataFrame) -> DataFrame:
    """The graph as text, with malformed lines among it: cut short, a word for a number, a comment, a fraction last, one token more."""
    row = F.concat_ws(" ", "src", "dest", "likes", "shares", "comments")
    kind = F.when(F.col("src") % 11 == 3, F.concat_ws(" ", "src", "dest", "likes")).when(F.col("src") % 11 == 4, F.concat(F.lit("# "), row)).when(F.col("src") % 11 == 5, F.concat(F.col("src").cast("string"), F.lit("x "), row)).when(F.col("src") % 11 == 6, F.concat(row, F.lit(".5"))).when(F.col("src") % 11 == 7, F.concat(F.lit("  "), row, F.lit(" extra"))).otherwise(row)
    order = F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in [*E.KEY, "occ"]])
    return g.select(kind.alias("value"), order.alias("n"))


def _metis(f):
    """link without directions, repeats and loops as the lines of a METIS file."""
    return _link(lambda g: f(_metis_lines(g)))


def _metis_lines(g: DataFrame) -> DataFrame:
    und = g.filter("src <> dest").select(F.explode(F.array(F.struct("src", "dest"), F.struct(F.col("dest").alias("src"), F.col("src").alias("dest")))).alias("e")).select("e.*").distinct()
    lists = und.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dest")), lambda x: (x + 1).cast("string")), " ").alias("value"))
    body = E.dense_vertices(g).join(lists, F.col("id") == F.col("src"), "left").select(F.coalesce("value", F.lit("")).alias("value"), (F.col("id") + 1).alias("n"))
    ends = und.agg(F.count(F.lit(1)).alias("ends"))
    head = g.agg((F.max(F.greatest("src", "dest")) + 1).alias("top")).crossJoin(F.broadcast(ends))  # one row each
    return body.unionByName(head.select(F.format_string("%d %d", "top", F.expr("ends div 2")).alias("value"), F.lit(0).cast("bigint").alias("n")))


def partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    parts = pipelines.balanced(recipes.link(spark, sf_dir), 3)
    checkpointed(spark.range(1))  # so that there is a shared folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/parts-{uuid.uuid4().hex}"
    T.write_parts(parts, path)
    return T.read_written_parts(spark, path)


def scan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = recipes.thirds(recipes.link(spark, sf_dir))
    name = F.concat(F.lit("partition_"), F.col("part").cast("string"), F.lit(".txt")).alias("file")
    rows = parts.select(name, F.explode(F.array(F.col("node").cast("string"), F.concat(F.lit(" "), F.col("node").cast("string")), F.lit("oops"))).alias("value"))
    return T.parse_parts(rows)


def _cac(g, comps, links):
    return C.cac(links, comps)


def _seeds_of(g: DataFrame) -> DataFrame:
    return E.pairs(g).select(F.col("src").alias("id")).distinct().orderBy("id").limit(3)


def _ic(sub: DataFrame, g: DataFrame, parts: DataFrame) -> DataFrame:
    return cascade.cascaded(sub, _seeds_of(g), parts, TRIALS, SEED)


def _ic_query(f):
    def run(g: DataFrame) -> DataFrame:
        parts = E.vertices(g).select(F.lit(0).alias("part"), F.col("id").alias("node"))
        sub = E.weighted(g, CAST).withColumn("part", F.lit(0))
        return f(sub, g, parts)

    return _trade(run)


def _greedy(g: DataFrame) -> DataFrame:
    parts = recipes.thirds(g)
    sub = checkpointed(E.subgraph(E.weighted(g, RANK), parts))
    return cascade.greedy(sub.filter("part = 0"), pipelines.candidate_pool(sub, parts, K, FIVE), K)


def _report(scope: str):
    def run(g: DataFrame) -> DataFrame:
        chosen, total = pipelines.spread_seeds(g, recipes.thirds(g), CAST, FIVE, SpreadOptions(K, TRIALS, SEED, scope))
        return chosen.crossJoin(F.broadcast(total))  # total is one row

    return _trade(run)


def _cuts(g: DataFrame, parts: DataFrame, start: DataFrame) -> DataFrame:
    return S.edge_cut(g, parts).crossJoin(F.broadcast(S.edge_cut(g, start).select(F.col("cut").alias("start"))))  # one row each


def _kway_cut(g: DataFrame) -> DataFrame:
    """n_edges, start (the cut of ids modulo 3) and cut, that of the split."""
    return _cuts(g, S.kway(g, 3), recipes.thirds(g))


def _kway(g: DataFrame) -> DataFrame:
    """The split's invariants: vertices, parts, and `balanced`: part sizes are even and the cut is at most that of the ranges it starts from."""
    parts = checkpointed(S.kway(g, 3))
    per = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("node").alias("d"))
    sums = per.agg(F.sum("c").alias("n_vertices"), F.sum("d").alias("n_distinct"), F.count(F.lit(1)).alias("n_parts"), (F.max("c") * 3 <= F.ceil(F.sum("c") * 1.03) + 3).alias("even"))
    index = checkpointed(E.vertex_index(g))
    ranges = index.select(F.col("id").alias("node"), F.expr(f"cast(idx * 3 div {max(index.count(), 1)} as int)").alias("part"))
    cuts = _cuts(g, parts, ranges)
    return sums.crossJoin(F.broadcast(cuts)).select("n_vertices", "n_distinct", "n_parts", (F.col("even") & (F.col("cut") <= F.col("start"))).alias("balanced"))


QUERIES = {
    "scan_edgelist": _link(lambda g: T.parse_edges(_lines(g), cap=250_000)),
    "scan_edgelist_weighted": _link(lambda g: T.parse_weighted(_lines(g), recipes.thirds(g), RANK).select("part", "src", "dest", _r8("w"))),
    "scan_triples": _link(lambda g: T.parse_triples(g.select(F.when(F.col("src") % 5 == 0, F.concat_ws(" ", "src", "dest")).otherwise(F.concat_ws(" ", "src", "dest", "likes")).alias("value")))),
    "scan_metis": _metis(T.parse_metis),
    "metis_header": _metis(T.check_metis),
    "scan_partitions": scan_partitions,
    "partition_write_roundtrip": partition_roundtrip,
    "edge_filter_valid": _link(lambda g: E.valid(g.withColumn("src", F.col("src") - 100))),
    "edge_quality": _link(lambda g: E.quality(g.withColumns({"src": F.col("src") - 100, "likes": F.col("likes") - 1}))),
    "edge_weight": _trade(lambda g: E.weighted(g, RANK).select("src", "dest", "occ", _r8("w"))),
    "edge_dedup": _dense(E.pairs),
    "vertex_set": _dense(E.vertices),
    "vertex_index": _link(E.vertex_index),
    "dense_vertices": _link(E.dense_vertices),
    "followers_followees": _dense(E.degrees),
    "psi": _link(lambda g: E.psi(g).select("src", "dest", _r8("psi"))),
    "influence_score": _link(lambda g: E.influence_score(g).select("id", _r8("score"))),
    "influence_ranking": _link(lambda g: I.ranking(E.influence_score(g)).select("place", "id", _r8("score"))),
    "subgraph_extract": _sub(lambda sub, parts: sub.drop("w")),
    "ghost_nodes": _sub(E.ghosts),
    "subgraph_stats": _sub(E.subgraph_stats),
    "reachability": _link(R.reachability),
    "bfs_zone": _link(lambda g: R.bfs(g, E.vertices(g).filter("id % 20 = 0"))),  # a search's queries: ids divisible by 20, in all the graph
    "bfs_info": _link(lambda g: R.zone_sizes(g, E.vertices(g)).select("root", "size", _r8("avg_dist"))),
    "scc": _link(C.scc),
    "scc_dense": _link(lambda g: C.scc(g, E.dense_vertices(g))),
    "scc_types": _comps(lambda g, c, d: C.scc_types(c)),
    "scc_sizes": _comps(lambda g, c, d: C.sizes(c)),
    "component_dag": _comps(lambda g, c, d: d),
    "dag_indegree": _comps(lambda g, c, d: C.in_degrees(d, c)),
    "component_levels": _comps(lambda g, c, d: C.levels(d, c)),
    "topo_levels": _comps(lambda g, c, d: I.ranking(C.levels(d, c).select((-F.col("scc")).alias("id"), (-F.col("level")).alias("level")), "level").select((-F.col("id")).alias("scc"), (-F.col("level")).alias("level"), F.col("place").alias("pos"))),
    "component_report": _comps(lambda g, c, d: C.report(c, C.levels(d, c))),
    "component_summary": _comps(lambda g, c, d: C.summary(c)),
    "cac": _comps(_cac),
    "cac_partition": _link(lambda g: pipelines.balanced(g, 3)),
    "kway_partition": _link(_kway),
    "kway_cut": _link(_kway_cut),
    "edge_cut": _link(lambda g: S.edge_cut(g, recipes.thirds(g))),
    "influence_power": _link(lambda g: I.power(g).select("id", _r8("power"))),
    "seed_candidates": _link(lambda g: I.candidates(_power(g)).select("id", "idx", _r8("power"))),
    "seed_select": _link(lambda g: I.seeds(g, _power(g), 3)),
    "influential": _dense(lambda g: pipelines.influential(g, 3)),
    "pr_effective_edges": _sub(lambda sub, parts: P.effective(sub).select("part", "src", "dest", "occ", _r8("w"))),
    "out_weight": _sub(lambda sub, parts: P.out_weights(P.effective(sub)).select("part", "src", _r8("out_w"))),
    "local_pagerank": _sub(lambda sub, parts: P.pagerank(sub, FIVE).select("part", "id", _r8("pr"))),
    "pagerank_converged": _sub(lambda sub, parts: P.pagerank(sub, RankOptions()).select("part", "id", F.round("pr", 7).alias("pr"))),
    "pagerank_convergence": _sub(lambda sub, parts: P.convergence(sub, RankOptions())),
    "local_pagerank_topk": _sub(lambda sub, parts: P.top(P.pagerank(sub, FIVE), parts, K).select("part", "pos", "id", _r8("pr"))),
    "candidate_pool": _sub(lambda sub, parts: pipelines.candidate_pool(sub, parts, 3, FIVE).select("part", "pos", "id")),
    "greedy_seeds": _trade(_greedy),
    "ic_live_edges": _ic_query(lambda sub, g, parts: cascade.live_edges(sub, TRIALS, SEED).groupBy("trial").agg(F.count(F.lit(1)).alias("n_live"))),
    "ic_spread": _ic_query(lambda sub, g, parts: _ic(sub, g, parts)),
    "ic_total": _ic_query(lambda sub, g, parts: cascade.total(_ic(sub, g, parts), TRIALS)),
    "run_metrics": _trade(lambda g: pipelines.spread_metrics(g, recipes.thirds(g), RANK, RankOptions())),
    "pipeline_report": _report("partition"),
    "pipeline_report_global": _report("global"),
}
