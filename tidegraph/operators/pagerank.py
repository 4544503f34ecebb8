"""Weighted PageRank inside every part of a split graph, all parts in one job; one part holding all vertices is the global rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import RankOptions
from . import blocks as B
from . import kernels as K
from .iterate import checkpointed


def effective(sub: DataFrame) -> DataFrame:
    """Edges whose destination has out-edges of its own in the part; the others take no rank."""
    sources = sub.select("part", F.col("src").alias("dest")).distinct()
    return sub.join(sources, ["part", "dest"], "left_semi")


def out_weights(eff: DataFrame) -> DataFrame:
    return eff.groupBy("part", "src").agg(F.sum("w").alias("out_w"))


def pagerank(sub: DataFrame, options: RankOptions, max_edges: int = K.MAX_EDGES, max_vertices: int = B.MAX_VERTICES) -> DataFrame:
    """(part, id, pr) from sub (part, src, dest, w): Jacobi steps; what vertices without a positive out-weight hold is lost; stops when a
    part's summed change is below tol, each part by itself, or after max_iter steps. A part of up to max_edges edges and vertices is ranked in a
    task, if that holds for all; else all parts move together, by `blocks`, or with over max_vertices vertices by joins."""
    return _ranked(sub, options, max_edges, max_vertices).select("part", "id", "pr")


def convergence(sub: DataFrame, options: RankOptions, max_edges: int = K.MAX_EDGES, max_vertices: int = B.MAX_VERTICES) -> DataFrame:
    """(part, n_nodes, n_steps, converged): how pagerank ended in every part."""
    ended = _ranked(sub, options, max_edges, max_vertices)
    return ended.groupBy("part").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("steps").alias("n_steps"), F.max("still").alias("converged"))


def _blocked(sub: DataFrame, names: B.PiecedNames, options: RankOptions) -> DataFrame:
    """Ranks of all parts at once: a step sends all ranks in pieces, and each block sums what its own vertices get. The driver sees a piece and each part's change."""
    links, n, d = B.Blocks(sub, names, lambda rows: rows.column("w").to_numpy(zero_copy_only=False), np.add, np.float64), len(names), options.d
    ends, parts, nb = names.ends, names.parts, links.count
    size, many = np.diff(ends), len(names.parts)
    out_w = B.Pieces(links.sums_of_sources(), np.zeros(many), ends, nb)
    pr, steps, still = B.Pieces(None, 1.0 / size, ends, nb), np.zeros(many, np.int32), np.zeros(many, dtype=bool)

    def stepped(pr: B.Pieces, still: np.ndarray) -> DataFrame:
        shares: list[np.ndarray] = []

        def run(own, s, first, x) -> Iterator[pa.RecordBatch]:
            if not shares:
                shares.append(np.divide(pr.value, out_w.value, out=out_w.value, where=out_w.value > 0))  # in place, as a task needs out_w once
            block = int(own[0]) % nb
            of, old, got = np.searchsorted(ends, np.arange(block, n, nb), "right") - 1, pr.value[block::nb], np.zeros(len(range(block, n, nb)))
            got[own // nb] = np.add.reduceat(shares[0][s] * x, first)
            new = np.where(still[of], old, (1 - d) / size[of] + d * got)
            moved = np.bincount(of, weights=np.abs(new - old), minlength=many)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "v": pa.array([new.tobytes()], pa.binary()), "moved": pa.array([moved.tobytes()], pa.binary())})

        return checkpointed(links.each(run, "block int, v binary, moved binary"))

    for i in range(options.max_iter):
        rows = stepped(pr, still)
        got = rows.select("block", "moved").toArrow()
        moved = np.sum([np.frombuffer(x.as_buffer()) for x in got["moved"]], axis=0)
        if i == 0:  # vertices of blocks without edges move in the first step alone
            for b in set(range(nb)) - set(got["block"].to_pylist()):
                moved = moved + np.diff((ends - 1 - b) // nb) * d / size
        last, pr, steps = pr, B.Pieces(rows.select("block", "v"), (1 - d) / size, ends, nb), (steps + ~still).astype(np.int32)
        last.destroy()
        if options.tol is not None:
            still = still | (moved < options.tol)
            if still.all():
                break
    out_w.destroy()
    some = 100_000

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column(0).to_pylist():
                of = np.searchsorted(ends, np.arange(low, min(n, low + some)), "right") - 1
                yield pa.RecordBatch.from_pydict({"part": pa.array(parts[of]), "id": pa.array(names.value.ids[low : low + some]), "pr": pa.array(pr.value[low : low + some]), "still": pa.array(still[of]), "steps": pa.array(steps[of])})

    spark = sub.sparkSession
    out = spark.range(0, n, some, max(1, min(-(-n // some), spark.sparkContext.defaultParallelism * 2))).mapInArrow(ranked, "part long, id long, pr double, still boolean, steps int")
    return out.withColumn("part", F.col("part").cast(sub.schema["part"].dataType))


def _ranked(sub: DataFrame, options: RankOptions, max_edges: int, max_vertices: int) -> DataFrame:
    sub = checkpointed(sub.select("part", "src", "dest", "w"))
    nodes = sub.select("part", F.col("src").alias("id")).distinct()
    if (sub.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > max_edges:
        nodes = checkpointed(nodes)
        if nodes.count() <= max_vertices:
            return _blocked(sub, B.PiecedNames(nodes), options)
    count = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    nodes = checkpointed(nodes.join(count, "part"))
    eff = effective(sub)
    share = eff.join(out_weights(eff).filter("out_w > 0"), ["part", "src"]).groupBy("part", "src", "dest").agg((F.sum("w") / F.first("out_w")).alias("p"))
    share = checkpointed(share.repartition("part", "src"))
    both = share.unionByName(nodes.select("part", F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dest"), F.lit(0.0).alias("p")))
    if (both.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= max_edges:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            links = pdf[pdf.dest.notna()]
            ids = np.sort(pdf.src[pdf.dest.isna()].to_numpy(dtype=np.int64))
            place = lambda x: np.searchsorted(ids, x.to_numpy(dtype=np.int64))
            pr, steps, still = K.pagerank(len(ids), place(links.src), place(links.dest), links.p.to_numpy(), options.d, options.max_iter, options.tol)
            return pd.DataFrame({"part": pdf.part.iloc[0], "id": ids, "pr": pr, "still": still, "steps": np.int32(steps)})

        return both.groupBy("part").applyInPandas(run, f"part {sub.schema['part'].dataType.simpleString()}, id long, pr double, still boolean, steps int")
    now = nodes.select("part", "id", "n", (F.lit(1.0) / F.col("n")).alias("pr"), F.lit(False).alias("still"), F.lit(0).alias("steps"))
    for i in range(options.max_iter):
        got = share.join(now.select("part", F.col("id").alias("src"), "pr"), ["part", "src"]).groupBy("part", F.col("dest").alias("id")).agg(F.sum(F.col("pr") * F.col("p")).alias("got"))
        new = (F.lit(1 - options.d) / F.col("n")) + F.lit(options.d) * F.coalesce("got", F.lit(0.0))
        step = now.join(got, ["part", "id"], "left").select("part", "id", "n", F.when(F.col("still"), F.col("pr")).otherwise(new).alias("pr"), F.abs(F.when(F.col("still"), 0.0).otherwise(new) - F.when(F.col("still"), 0.0).otherwise(F.col("pr"))).alias("change"), "still", F.when(F.col("still"), F.col("steps")).otherwise(i + 1).alias("steps"))
        if options.tol is None:
            now = step.drop("change")
            if i % 5 == 4:
                now = checkpointed(now)
            continue
        step = checkpointed(step)
        moved = step.groupBy("part").agg(F.sum("change").alias("moved"))
        now = step.drop("change").join(moved, "part").withColumn("still", F.col("still") | (F.col("moved") < options.tol)).drop("moved")
        now = checkpointed(now)
        if not now.filter("not still").limit(1).count():
            break
    return now


def top(ranks: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(part, pos, id, pr): each part's k highest among its own vertices, ties to the smaller id."""
    own = ranks.join(parts.withColumnRenamed("node", "id"), ["part", "id"], "left_semi")
    pos = F.row_number().over(Window.partitionBy("part").orderBy(F.desc(F.round("pr", 10)), "id"))
    return own.withColumn("pos", pos).filter(F.col("pos") <= k).select("part", "pos", "id", "pr")
