"""Strong components, their DAG, levels, and single-parent trees (CACs)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .edges import pairs
from .iterate import checkpointed, fixpoint, is_table


def _is_small(edges: DataFrame, limit: int) -> bool:
    return edges.count() <= limit  # a limit would bring that many rows of every task into one


def _mostly_different(edges: DataFrame, limit: int) -> bool:
    """Whether edges, a table, surely have over limit different pairs, and few rows are copies: told by a sketch of 2 % error, as either form gives the same components."""
    n, about = edges.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("src", "dest"), 0.02)).first()
    return about > 1.2 * limit and about > 0.8 * n


def scc(edges: DataFrame, ids: DataFrame | None = None, max_edges: int = K.MAX_EDGES, max_vertices: int = B.MAX_VERTICES) -> DataFrame:
    """(id, scc): scc is the least member's id. ids adds isolated vertices. Up to max_edges distinct pairs one task does it; beyond, steps over `blocks`, or
    with over max_vertices vertices rounds of colouring by joins. A table of many edges, few of them copies, isn't shuffled to drop these: blocks leave one of parallel edges."""
    large = is_table(edges) and _mostly_different(edges, max_edges)
    edges = edges.select("src", "dest") if large else checkpointed(pairs(edges))
    if not large and _is_small(edges, max_edges):

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            names, s, d = K.compact(pdf.src.to_numpy(), pdf.dest.to_numpy())
            return pd.DataFrame({"id": names, "scc": names[K.strong_components(len(names), s, d)]})

        found = edges.groupBy(F.lit("all")).applyInPandas(run, "id long, scc long")
    else:
        rows = edges.select(F.lit(0).alias("part"), "src", "dest")
        names = B.names_of(rows.select("part", F.explode(F.array("src", "dest")).alias("id")).distinct(), max_vertices)
        found = colored_scc(edges) if names is None else blocked_scc(rows, names, max_edges)
    if ids is not None:
        found = ids.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    return found


def blocked_scc(rows: DataFrame, names: B.Names, max_edges: int) -> DataFrame:
    """The same by steps over blocks. What can be in one component shares a class. Vertices without in- or out-edges within their class are components of their
    own; what a vertex of many edges reaches and is reached by is one, and splits the classes; once max_edges edges at most are left within
    classes, a task does the rest. Where that vertex's component was small, each vertex instead takes the least that reaches it within its class, and what leads back there is a component."""
    on, back, n = B.Blocks(rows, names), B.Blocks(rows, names, back=True), len(names)
    cls, comp = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)  # class -1: done
    colors = False

    def degree(own, s, first, x, cls):
        if not len(s):
            return own, np.zeros(0, np.int64)
        ends = np.repeat(own, np.diff(np.append(first, len(s))))
        within = (cls[s] == cls[ends]) & (cls[s] >= 0) & (s != ends)
        return own, np.add.reduceat(within.astype(np.int64), first)

    def moved(own, s, first, x, cls, front, seen):
        if not len(s):
            return own, front[:0]
        ends = np.repeat(own, np.diff(np.append(first, len(s))))
        got = np.maximum.reduceat(np.where(cls[s] == cls[ends], front[s], 0).astype(np.uint8), first)
        new = (got > 0) & (seen[own] == 0) & (cls[own] >= 0)
        return own[new], got[new]

    def reach(links: B.Blocks, start: np.ndarray) -> np.ndarray:
        seen = front = start
        while True:
            at, _ = links.step(moved, cls, front, seen)
            if not len(at):
                return seen
            front = np.zeros(n, np.uint8)
            front[at] = 1
            seen = seen | front

    def least(own, s, first, x, cls, color):
        if not len(s):
            return own, color[:0]
        ends = np.repeat(own, np.diff(np.append(first, len(s))))
        got = np.minimum.reduceat(np.where((cls[s] == cls[ends]) & (cls[s] >= 0), color[s], n).astype(np.int32), first)
        new = got < color[own]
        return own[new], got[new]

    while True:
        while True:  # trimming, both ways at once
            degrees = []
            for links in (on, back):
                at, value = links.step(degree, cls)
                degrees.append(np.zeros(n, np.int64))
                degrees[-1][at] = value
            alone = (cls >= 0) & ((degrees[0] == 0) | (degrees[1] == 0))
            cls[alone] = -1
            left = int(degrees[0].sum())
            if left <= max_edges or alone.sum() * 100 < (cls >= 0).sum() or not alone.any():
                break
        if left <= max_edges:
            break
        if colors:
            color = np.where(cls >= 0, np.arange(n, dtype=np.int32), n).astype(np.int32)
            while True:
                at, value = on.step(least, cls, color)
                if not len(at):
                    break
                color[at] = value
            cls = np.where(cls >= 0, color, -1).astype(np.int32)
            found = reach(back, ((cls >= 0) & (cls == np.arange(n))).astype(np.uint8)) > 0
            comp[found] = cls[found]
            cls[found] = -1
        else:
            pivot = np.zeros(n, np.uint8)
            pivot[np.argmax(np.where(cls >= 0, degrees[0] * degrees[1], -1))] = 1
            fore, aft = reach(on, pivot), reach(back, pivot)
            found = (fore & aft) > 0
            comp[found] = np.flatnonzero(found)[0]
            colors = found.sum() * 10 < (cls >= 0).sum()
            cls = np.where((cls < 0) | found, -1, fore + 2 * aft + 4 * cls).astype(np.int32)
            cls = np.where(cls < 0, -1, np.unique(cls, return_inverse=True)[1]).astype(np.int32)
    if left:

        def rest(own, s, first, x, cls) -> Iterator[pa.RecordBatch]:
            ends = np.repeat(own, np.diff(np.append(first, len(s))))
            some = (cls[s] == cls[ends]) & (cls[s] >= 0)
            yield pa.RecordBatch.from_pydict({"s": s[some].astype(np.int64), "d": ends[some].astype(np.int64)})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own, s, d = K.compact(pdf.s.to_numpy(), pdf.d.to_numpy())
            return pd.DataFrame({"at": own, "comp": own[K.strong_components(len(own), s, d)]})

        got = on.each(rest, "s long, d long", cls).groupBy(F.lit("all")).applyInPandas(run, "at long, comp long").toArrow()
        comp[got["at"].to_numpy()] = got["comp"].to_numpy()
    return B.table(rows.sparkSession, "id long, scc long", id=names.ids, scc=names.ids[comp])


def colored_scc(edges: DataFrame) -> DataFrame:
    """The same by DataFrames: vertices without in- or out-edges left are components of their own; then each takes the least id that reaches it, and
    what goes back to that id within its colour is its component; so on with the rest."""
    edges = checkpointed(pairs(edges))
    left = edges.select(F.explode(F.array("src", "dest")).alias("id")).distinct()
    done = []
    while not left.isEmpty():
        while True:  # trimming, both ways at once
            inner = checkpointed(edges.filter("src <> dest"))
            n = inner.count()
            has_in, has_out = inner.select(F.col("dest").alias("id")).distinct(), inner.select(F.col("src").alias("id")).distinct()
            core = checkpointed(has_in.join(has_out, "id", "left_semi"))
            edges = checkpointed(inner.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dest"), "dest", "left_semi").select("src", "dest"))
            done.append(checkpointed(left.join(core, "id", "left_anti").select("id", F.col("id").alias("scc"))))
            left = core
            if edges.count() == n or left.isEmpty():
                break
        if left.isEmpty():
            break
        color = checkpointed(left.withColumn("c", F.col("id")))
        while True:
            told = edges.join(color.withColumnsRenamed({"id": "src", "c": "n"}), "src").groupBy(F.col("dest").alias("id")).agg(F.min("n").alias("n"))
            new = checkpointed(color.join(told, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
            moved = new.filter("moved").limit(1).count()
            color = new.drop("moved")
            if not moved:
                break
        same = edges.join(color.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(color.withColumnsRenamed({"id": "dest", "c": "cd"}), "dest").filter("cs = cd").select("src", "dest", F.col("cs").alias("c"))
        same = checkpointed(same)
        back = fixpoint(color.filter("id = c"), lambda b: b.unionByName(same.join(b.withColumnRenamed("id", "dest"), ["dest", "c"]).select(F.col("src").alias("id"), "c")).distinct())
        done.append(back.select("id", F.col("c").alias("scc")))
        left = checkpointed(left.join(back, "id", "left_anti"))
        edges = checkpointed(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dest"), "dest", "left_semi").select("src", "dest"))
    out = done[0] if done else left.select("id", F.col("id").alias("scc"))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def scc_types(comps: DataFrame) -> DataFrame:
    """type s: of a component of several vertices; c: alone."""
    size = comps.groupBy("scc").agg(F.count(F.lit(1)).alias("size"))
    return comps.join(size, "scc").select("id", "scc", F.when(F.col("size") > 1, "s").otherwise("c").alias("type"))


def sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("scc").agg(F.count(F.lit(1)).alias("size"))


def dag(edges: DataFrame, comps: DataFrame, max_edges: int = K.MAX_EDGES, max_vertices: int = B.MAX_VERTICES) -> DataFrame:
    """Distinct (cu, cv) of edges that leave their component. Beyond max_edges edges, workers look the ends up in vectors of up to max_vertices vertices, and
    only edges that leave are shuffled; otherwise ends are joined."""
    edges, comps = edges.select("src", "dest").dropna(), comps.select("id", "scc")
    if _is_small(edges, max_edges) or comps.count() > max_vertices:
        of = lambda end, name: comps.select(F.col("id").alias(end), F.col("scc").alias(name))
        return pairs(edges).join(of("src", "cu"), "src").join(of("dest", "cv"), "dest").filter("cu <> cv").select("cu", "cv").distinct()
    got = comps.toArrow()
    ids, scc = got["id"].to_numpy(), got["scc"].to_numpy()
    held = edges.sparkSession.sparkContext.broadcast((B.Names(np.zeros(len(ids), np.int64), ids), scc[np.argsort(ids, kind="stable")]))

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of = held.value
        for batch in batches:
            one = np.zeros(batch.num_rows, np.int64)
            (s, a), (d, b) = (names.places(one, batch.column(i).to_numpy()) for i in range(2))
            cu, cv = of[s[a & b]], of[d[a & b]]
            yield pa.RecordBatch.from_pydict({"cu": cu[cu != cv], "cv": cv[cu != cv]})

    return edges.mapInArrow(leaving, "cu long, cv long").distinct()


def in_degrees(links: DataFrame, comps: DataFrame) -> DataFrame:
    got = links.groupBy(F.col("cv").alias("scc")).agg(F.count(F.lit(1)).alias("n"))
    return comps.select("scc").distinct().join(got, "scc", "left").select("scc", F.coalesce("n", F.lit(0)).alias("indeg"))


def levels(links: DataFrame, comps: DataFrame, max_edges: int = K.MAX_EDGES) -> DataFrame:
    """(scc, level): 1 for sources, else one more than the highest level that points to it."""
    links, own = checkpointed(links), comps.select("scc").distinct()
    if _is_small(links, max_edges):

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            names, s, d = K.compact(pdf.cu.to_numpy(), pdf.cv.to_numpy())
            return pd.DataFrame({"scc": names, "level": K.longest_levels(len(names), s, d)})

        found = links.groupBy(F.lit("all")).applyInPandas(run, "scc long, level long")
        return own.join(found, "scc", "left").select("scc", F.coalesce("level", F.lit(1)).cast("bigint").alias("level"))
    now = checkpointed(own.withColumn("level", F.lit(1).cast("bigint")))
    while True:  # a round a level
        told = links.join(now.withColumnRenamed("scc", "cu"), "cu").groupBy(F.col("cv").alias("scc")).agg((F.max("level") + 1).alias("up"))
        new = checkpointed(now.join(told, "scc", "left").select("scc", F.greatest("level", F.coalesce("up", "level")).alias("level"), (F.coalesce("up", "level") > F.col("level")).alias("moved")))
        now = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return now


def cac(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(scc, cac): components with one parent follow it, by pointer jumping; roots are those with none or several."""
    parent = links.groupBy(F.col("cv").alias("scc")).agg(F.count(F.lit(1)).alias("n"), F.min("cu").alias("p")).filter("n = 1")
    now = checkpointed(comps.select("scc").distinct().join(parent, "scc", "left").select("scc", F.coalesce("p", "scc").alias("p")))
    while True:
        far = now.select(F.col("scc").alias("p"), F.col("p").alias("q"))
        new = checkpointed(now.join(far, "p").select("scc", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        now = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return now.select("scc", F.col("p").alias("cac"))


def report(comps: DataFrame, lv: DataFrame) -> DataFrame:
    members = comps.groupBy("scc").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"), F.count(F.lit(1)).alias("size"))
    return members.join(lv, "scc").select("scc", "size", F.when(F.col("size") > 1, "s").otherwise("c").alias("type"), "level", "members")


def summary(comps: DataFrame) -> DataFrame:
    """Vertices of either type, as the classic report counts them, and true counts of components."""
    s = sizes(comps)
    sum0 = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return s.agg(F.count(F.lit(1)).alias("components"), sum0(F.when(F.col("size") > 1, F.col("size"))).alias("scc_vertices"), sum0(F.when(F.col("size") == 1, 1)).alias("cac_vertices"), F.count_if(F.col("size") > 1).alias("scc_components"), F.count_if(F.col("size") == 1).alias("cac_components"))
