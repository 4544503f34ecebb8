"""Golden values on a small graph with all the odd lines, equivalence of kernels and DataFrame versions, and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.operators import cascade, components as C, edges as E, influence as I, kernels as K, pagerank as P, partition as S, reach as R
from tidegraph.options import RankOptions, SpreadOptions, Weights
from tidegraph.sources import text as T

TOY = """1 2 5 0 1
2 3 0 4 0
3 1 2 2 2
1 2 9 9 9
3 4 1 0 3
4 5 6 0 0
5 4 0 0 2
5 6 3 1 0
3 6 0 2 0
6 7 1 1 1
8 8 4 0 0
10 9 -1 0 0
12 10 2 0 1 extra
# comment line
7 3 1 1
-1 5 1 1 1
3 9x 1 1 1
12 8 0 1 4.5"""


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("toy") / "edges.txt"
    path.write_text(TOY)
    scanned = T.read_edges(spark, str(path))
    assert scanned.count() == 15
    assert T.read_edges(spark, str(path), cap=3).count() == 3
    assert (12, 8, 0, 1, 4) in {tuple(r) for r in scanned.collect()}
    return E.with_occ(E.valid(scanned)).cache()


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_edges(spark, toy):
    assert toy.count() == 14 and E.pairs(toy).count() == 13
    assert rows(E.degrees(toy), "id", "followees", "followers") >= {(3, 3, 1), (4, 1, 2), (8, 1, 2), (12, 2, 0), (9, 0, 1)}
    assert rows(E.vertex_index(toy), "id", "idx") == {(v, i) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12])}
    score = {i: round(s, 6) for i, s in rows(E.influence_score(toy), "id", "score")}
    assert score[1] == score[10] == 0.863636 and score[4] == score[8] == 0.877273 and score[7] == 0.013636 and score[12] == 0.85
    assert E.dense_vertices(toy).count() == 13


def test_components(spark, toy):
    comps = C.scc(toy).cache()
    assert rows(comps, "id", "scc") == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), *((i, i) for i in (6, 7, 8, 9, 10, 12))}
    assert rows(C.colored_scc(toy), "id", "scc") == rows(comps, "id", "scc")
    assert rows(C.scc_types(comps).filter("type = 's'"), "id") == {(i,) for i in range(1, 6)}
    links = C.dag(toy, comps).cache()
    assert rows(links, "cu", "cv") == {(1, 4), (1, 6), (4, 6), (6, 7), (10, 9), (12, 8), (12, 10)}
    want = {(1, 1), (4, 2), (6, 3), (7, 4), (12, 1), (8, 2), (10, 2), (9, 3)}
    assert rows(C.levels(links, comps), "scc", "level") == rows(C.levels(links, comps, max_edges=1), "scc", "level") == want
    assert rows(C.cac(links, comps), "scc", "cac") == {(1, 1), (4, 1), (6, 6), (7, 6), (12, 12), (8, 12), (10, 12), (9, 12)}
    assert tuple(C.summary(comps).first()) == (8, 5, 6, 2, 6)


def test_lpt(spark, toy):
    comps = C.scc(toy, E.dense_vertices(toy)).cache()
    got = S.cac_partition(comps, C.cac(C.dag(toy, comps), comps), 3).groupBy("part").agg(F.sort_array(F.collect_list("node")).alias("m"))
    assert {tuple(r.m) for r in got.collect()} == {(8, 9, 10, 12), (0, 1, 2, 3, 4, 5), (6, 7, 11)}
    with pytest.raises(ValueError):
        S.lpt(comps, 0)


def test_reach_and_power(spark, toy):
    zones = R.bfs(toy, E.vertices(toy))
    info = {r.root: (r.size, round(r.avg_dist, 6)) for r in R.bfs_info(zones).collect()}
    assert info[1] == (7, 2.428571) and info[3] == (7, 1.285714) and info[10] == (2, 0.5) and info[12] == (4, 1.0) and info[7] == (1, 0)
    assert rows(R.bfs(toy, E.vertices(toy), max_edges=1), "root", "node", "dist") == rows(zones, "root", "node", "dist")
    every = E.vertices(toy).unionByName(spark.createDataFrame([(77,)], "id long"))
    short = lambda df: {(r.root, r.size, round(r.avg_dist, 9)) for r in df.collect()}
    assert short(R.zone_sizes(toy, every)) == short(R.zone_sizes(toy, every, max_edges=1)) == short(R.bfs_info(R.bfs(toy, every)))
    assert rows(R.reachability(toy), "root", "node") == rows(zones, "root", "node")
    power = I.power(toy).cache()
    got = {r.id: round(r.power, 6) for r in power.collect()}
    assert got[1] == got[2] == got[3] == 5.222727 and got[4] == 2.631818 and got[12] == 2.604545 and got[6] == 0.890909 and got[9] == 0.013636
    assert {r.id: round(r.power, 6) for r in I.power(toy, max_edges=1).collect()} == got
    assert rows(I.candidates(power), "id") == {(2,), (3,)}
    assert rows(I.seeds(toy, power, 3), "pos", "id") == {(1, 3), (2, 2)}
    with pytest.raises(ValueError):
        I.seeds(toy, power, 0)


def test_pagerank(spark, toy):
    sub = E.weighted(toy, Weights(0.1, 0.5, 0.8)).withColumn("part", F.lit(0))
    ranks = {r.id: round(r.pr, 8) for r in P.pagerank(sub, RankOptions()).collect()}
    two = sub.unionByName(sub.filter("src < 6").withColumn("part", F.lit(1)))
    for options in (RankOptions(), RankOptions(max_iter=3), RankOptions(max_iter=0), RankOptions(max_iter=7, tol=None)):  # in tasks, and by joins
        a, b = ({(r.part, r.id): r.pr for r in P.pagerank(two, options, limit).collect()} for limit in (K.MAX_EDGES, 1))
        assert a == pytest.approx(b) and rows(P.convergence(two, options), "part", "n_nodes", "n_steps", "converged") == rows(P.convergence(two, options, 1), "part", "n_nodes", "n_steps", "converged")
    assert len(ranks) == 9 and ranks[8] == 0.18546099 and ranks[5] == 0.09217309 and ranks[1] == 0.03894672 and round(sum(ranks.values()), 6) == 0.601238
    parts = E.vertices(toy).select(F.lit(0).alias("part"), F.col("id").alias("node"))
    assert [r.id for r in P.top(P.pagerank(sub, RankOptions()), parts, 3).orderBy("pos").collect()] == [8, 5, 4]


def test_options():
    for bad in (lambda: RankOptions(d=1.0), lambda: RankOptions(d=0.0), lambda: SpreadOptions(k=0), lambda: SpreadOptions(trials=0), lambda: SpreadOptions(scope="x")):
        with pytest.raises(ValueError):
            bad()


def test_coins(spark):
    """Coins of edges and trials are spread evenly, and neither neighbouring edges nor trials go together."""
    from tidegraph.functions.expressions import coins

    edges = spark.range(2000).select(F.lit(0).alias("part"), F.col("id").alias("src"), (F.col("id") * 3 % 71).alias("dest"), F.lit(1).alias("likes"), (F.col("id") % 2).alias("shares"), F.lit(0).alias("comments"), F.lit(1).alias("occ"))
    u = np.array([r.u for r in coins(edges, 20, 42).orderBy("src", "trial").collect()]).reshape(2000, 20)
    assert 0 <= u.min() and u.max() < 1 and abs(np.histogram(u, 50, (0, 1))[0] - 800).max() < 150
    assert abs(np.corrcoef(u.T) - np.eye(20)).max() < 0.12 and all(abs(np.corrcoef(u[:-k].ravel(), u[k:].ravel())[0, 1]) < 0.03 for k in (1, 2, 3, 71))
    assert u.tolist() != [r for r in np.array([r.u for r in coins(edges, 20, 43).orderBy("src", "trial").collect()]).reshape(2000, 20).tolist()]


def test_cascade_limits(spark, toy):
    parts = E.vertices(toy).select(F.lit(0).alias("part"), F.col("id").alias("node"))
    seeds = spark.createDataFrame([(1,), (12,), (99,)], "id long")
    sub = toy.withColumn("part", F.lit(0))
    sure = cascade.live_edges(sub.withColumn("w", F.lit(1.0)), 3, 1)
    never = cascade.live_edges(sub.withColumn("w", F.lit(0.0)), 3, 1)
    assert rows(cascade.spread(sure, seeds, parts, 3), "trial", "active") == {(t, 12) for t in range(3)}
    assert rows(cascade.spread(sure, seeds, parts, 3, max_edges=1), "trial", "active") == {(t, 12) for t in range(3)}
    assert rows(cascade.spread(never, seeds, parts, 3), "trial", "active") == {(t, 3) for t in range(3)}


def test_greedy_is_stable_top_k(spark, toy):
    pool = spark.createDataFrame([(0, 1, 4), (0, 2, 1), (1, 1, 4), (1, 2, 2), (2, 1, 77)], "part int, pos int, id long")
    assert [(r.id, r.spread) for r in cascade.greedy(toy, pool, 4).orderBy("pos").collect()] == [(1, 7), (2, 7), (4, 4), (77, 1)]


@pytest.mark.parametrize("max_edges", [K.MAX_EDGES, 1])  # by levels in a task, and by swaps
def test_kway(spark, toy, max_edges):
    parts = S.kway(toy, 2, max_edges=max_edges).collect()
    assert sorted(r.node for r in parts) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12]
    sizes = np.bincount([r.part for r in parts])
    assert len(sizes) == 2 and sizes.max() <= 6
    frame = spark.createDataFrame(parts)
    ranges = E.vertex_index(toy).select(F.col("id").alias("node"), F.expr("cast(idx * 2 div 11 as int)").alias("part"))
    assert S.edge_cut(toy, frame).first()["cut"] <= S.edge_cut(toy, ranges).first()["cut"]


def test_text_formats(spark, tmp_path):
    lines = spark.createDataFrame([(0, "3 2"), (1, "2 3"), (2, "1"), (3, "1")], "n long, value string")
    assert rows(T.parse_metis(lines), "src", "dest") == {(0, 1), (0, 2), (1, 0), (2, 0)}
    assert T.check_metis(lines).first()["consistent"]
    triples = spark.createDataFrame([("1 2 3.5",), ("1 2",), ("x 2 3",), (" 4 5 6 7",)], "value string")
    assert rows(T.parse_triples(triples), "src", "dest", "w") == {(1, 2, 3.5), (4, 5, 6.0)}
    parts = spark.createDataFrame([(0, 5), (1, 6), (1, 7)], "part int, node long")
    T.write_parts(parts, str(tmp_path / "p"))
    assert rows(T.read_written_parts(spark, str(tmp_path / "p")), "part", "node") == {(0, 5), (1, 6), (1, 7)}
    (tmp_path / "q_3.txt").write_text("1\n2\n2\nx\n")
    assert rows(T.read_parts(spark, str(tmp_path / "q_3.txt")), "part", "node") == {(3, 1), (3, 2)}
    (tmp_path / "q_4.txt").write_text("")
    with pytest.raises(ValueError):
        T.read_parts(spark, str(tmp_path / "q_4.txt"))


def test_files(spark, tmp_path):
    """Lines keep their order over blocks of a file; METIS files are held against their headers; what isn't there is an error."""
    (tmp_path / "long.txt").write_text("".join(f"{i} {i + 1} 1 1 1\n" for i in range(5000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = T.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert {(r.n, r.value.split()[0]) for r in lines.collect()} == {(i, str(i)) for i in range(5000)}
        assert rows(T.read_edges(spark, str(tmp_path / "long.txt"), cap=1234), "src") == {(i,) for i in range(1234)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    (tmp_path / "m.txt").write_text("3 2\n2 3\n1\n1\n")
    assert rows(T.read_metis(spark, str(tmp_path / "m.txt")), "src", "dest") == {(0, 1), (0, 2), (1, 0), (2, 0)}
    (tmp_path / "m.txt").write_text("3 5\n2 3\n1\n1\n4 4\n")
    with pytest.warns(UserWarning, match="10 ends expected, 6 found|10 ends expected, 4 found"):
        assert T.read_metis(spark, str(tmp_path / "m.txt")).count() == 4
    for text, error in (("3 2\n2 3\n1\n", "2 adjacency lines"), ("", "no header"), ("x\n", "no header")):
        (tmp_path / "m.txt").write_text(text)
        with pytest.raises(ValueError, match=error):
            T.read_metis(spark, str(tmp_path / "m.txt"))
    for read in (T.read_edges, T.read_metis, T.read_parts):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "nowhere.txt"))
    (tmp_path / "none.txt").write_text("")
    assert T.read_edges(spark, str(tmp_path / "none.txt")).count() == 0


def test_metrics(spark, toy, tmp_path):
    from pyspark.sql import Observation

    from tidegraph.plans.pipelines import spread_metrics

    (tmp_path / "e.txt").write_text(TOY)
    seen = Observation("edges")
    T.read_edges(spark, str(tmp_path / "e.txt"), seen=seen).collect()
    assert seen.get == {"n_edges": 15}
    parts = E.vertices(toy).select((F.col("id") > 6).cast("int").alias("part"), F.col("id").alias("node")).unionByName(spark.createDataFrame([(2, 70)], "part int, node long"))
    got = {r.part: tuple(r)[1:] for r in spread_metrics(toy, parts, Weights(), RankOptions(max_iter=2)).collect()}
    assert got[2] == (0, 0, 0, 0, False) and got[0][:2] == (10, 1) and got[0][3:] == (2, False) and got[1][0] == 5


def test_places(spark):
    from tidegraph.functions.ranks import placed
    from tidegraph.operators.iterate import checkpointed

    frame = spark.createDataFrame([(i * 7919 % 1000, None if i == 5 else f"s{i % 3}") for i in range(1000)], "a long, s string").repartition(5)
    want = sorted(frame.collect(), key=lambda r: (r.s is None, r.s or "", -r.a))
    got = placed(frame, F.col("s").asc_nulls_last(), F.desc("a"), cut=checkpointed).orderBy("place").collect()
    assert [(r.a, r.s, r.place) for r in got] == [(r.a, r.s, i) for i, r in enumerate(want)]


def test_split_by_levels():
    """Grids and hidden groups: parts within the limit, cuts below those of ranges and near what is known to be possible."""
    from tidegraph.operators import multilevel as M

    rng = np.random.default_rng(3)
    at = np.arange(2500).reshape(50, 50)
    grid = rng.permutation(2500)[np.stack([np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])])]
    group = rng.integers(0, 3, 2500)
    links = np.array([(x, y) for x, y in rng.integers(0, 2500, (40_000, 2)) if x < y and (group[x] == group[y] or rng.random() < 0.1)])
    for a, b, k, known in ((*np.sort(grid, axis=0), 2, 50), (*np.unique(links, axis=0).T, 3, None)):
        one = np.ones(len(a), np.int64)
        part = M.split(2500, a, b, k)
        ranges, cut = M.laid_out(np.arange(2500), np.ones(2500, np.int64), k), M.cut_of(part, a, b, one)
        assert np.bincount(part, minlength=k).max() <= np.ceil(2500 * 1.03 / k) and cut <= M.cut_of(ranges, a, b, one)
        assert cut <= (2.5 * known if known else 1.1 * M.cut_of(group, a, b, one))
    none = np.zeros(0, np.int64)
    assert M.split(0, none, none, 3).tolist() == [] and sorted(np.bincount(M.split(7, none, none, 3), minlength=3)) == [2, 2, 3]


def test_kway_cut(spark):
    """Two cliques, split by id modulo 3: the split's cut is counted, and is below the start's."""
    from tidegraph.plans import queries as Q

    links = spark.createDataFrame([(i, j) for base in (0, 30, 60) for i in range(base, base + 12) for j in range(base, i)], "src long, dest long")
    row = Q._kway_cut(links).first()
    parts = {r.node: r.part for r in S.kway(links, 3).collect()}
    assert row.n_edges == 3 * 66 and row.cut == sum(parts[r.src] != parts[r.dest] for r in links.collect()) < row.start


def test_stream(spark, tmp_path):
    from tidegraph.streaming.edges import stream_edges

    (tmp_path / "a.txt").write_text(TOY)
    query = stream_edges(spark, str(tmp_path)).writeStream.format("memory").queryName("edges_seen").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("edges_seen").count() == 15


graphs = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=30)


@settings(max_examples=60, deadline=None)
@given(graphs)
def test_kernels(links):
    ids, s, d = K.compact(*(np.array(x) for x in zip(*links, strict=True)))
    n = len(ids)
    far = np.eye(n, dtype=bool)
    far[s, d] = True
    for _ in range(4):
        far = far @ far
    comp = K.strong_components(n, s, d)
    both = far & far.T
    assert comp.tolist() == [int(np.flatnonzero(both[i])[0]) for i in range(n)]
    starts, to = K.csr(n, s, d)
    for root in range(n):
        assert K.distances(starts, to, root)[0].tolist() == np.flatnonzero(far[root]).tolist()
    cut = comp[s] != comp[d]
    dag = np.unique(np.stack([comp[s][cut], comp[d][cut]]), axis=1) if cut.any() else np.zeros((2, 0), dtype=int)
    level = K.longest_levels(n, dag[0], dag[1])
    assert (level[dag[1]] > level[dag[0]]).all()
    roots = np.arange(n).repeat(20)[:130]  # over two words of bits
    size, total = K.reached(starts, to, roots)
    want = [K.distances(starts, to, int(r)) for r in roots]
    assert size.tolist() == [len(x[0]) for x in want] and total.tolist() == [int(x[1].sum()) for x in want]
    values = np.arange(2 * n).reshape(n, 2)
    for target in (np.arange(n), np.arange(n)[::2]):
        there = np.eye(n, dtype=bool)
        there[dag[0], dag[1]] = True
        for _ in range(4):
            there = there @ there
        assert K.reach_sums(target, values, dag[0], dag[1], level).tolist() == (there[:, target].astype(int) @ values[target]).tolist()


def random_graph(spark, n, m, seed=1):
    links = np.random.default_rng(seed).integers(0, n, (m, 2))
    return spark.createDataFrame([(int(a), int(b), int(a) % 5, int(b) % 3, 1, i) for i, (a, b) in enumerate(links)], "src long, dest long, likes int, shares int, comments int, occ int").cache()


def test_ranks_in_blocks(spark, monkeypatch):
    """Parts of several blocks: ranks and steps are those of one task, and of joins."""
    from tidegraph.operators import blocks as B

    monkeypatch.setattr(B, "EDGES", 40)
    sub = E.weighted(random_graph(spark, 60, 300), Weights()).withColumn("part", (F.col("occ") % 3).cast("int"))
    for options in (RankOptions(), RankOptions(max_iter=5, tol=None)):
        got = [{(r.part, r.id): r.pr for r in P.pagerank(sub, options, *limit).collect()} for limit in ((), (1,), (1, 1))]
        assert got[0] == pytest.approx(got[1]) and got[0] == pytest.approx(got[2])
        assert len({frozenset(rows(P.convergence(sub, options, *limit), "part", "n_nodes", "n_steps", "converged")) for limit in ((), (1,), (1, 1))}) == 1


def test_cascade_in_blocks(spark, monkeypatch):
    """Coins as bits give what listed live edges give, over 64 trials too, with seeds that no edge touches and a part without edges."""
    from tidegraph.operators import blocks as B

    monkeypatch.setattr(B, "EDGES", 40)
    sub = random_graph(spark, 60, 100).withColumns({"w": (F.col("occ") % 7) / 6, "part": (F.col("occ") % 2).cast("int")})
    seeds, parts = spark.createDataFrame([(1,), (5,), (9999,)], "id long"), spark.createDataFrame([(0, 1), (1, 1), (2, 3)], "part int, node long")
    want = rows(cascade.spread(cascade.live_edges(sub, 70, 42), seeds, parts, 70), "part", "trial", "active")
    assert len(want) == 210 and rows(cascade.cascaded(sub, seeds, parts, 70, 42), "part", "trial", "active") == want
    assert rows(cascade.cascaded(sub, seeds, parts, 70, 42, max_vertices=1), "part", "trial", "active") == want


def test_frontiers_of_a_checkpoint(spark, toy):
    """What is seen starts as the frontier itself; roots here come out of a filter, whose constraints a union of both once failed on."""
    pool = spark.createDataFrame([(0, 1, 4), (0, 2, 1), (1, 1, 4), (1, 2, 2), (2, 1, 77)], "part int, pos int, id long")
    assert [(r.id, r.spread) for r in cascade.greedy(toy, pool, 4, max_edges=1).orderBy("pos").collect()] == [(1, 7), (2, 7), (4, 4), (77, 1)]
    roots = pool.filter("id > 0 and pos = 1").select("id")
    assert rows(R.frontier_bfs(toy, roots.select(F.col("id").alias("root")).distinct()), "root", "node", "dist") == rows(R.bfs(toy, roots), "root", "node", "dist")


@pytest.mark.parametrize(("n", "m"), [(60, 70), (300, 330), (100, 450)])
def test_components_in_blocks(spark, monkeypatch, n, m):
    """Sparse graphs of many small components and dense ones of one large: the same by blocks and in one task, whether or not a task does the rest."""
    from tidegraph.operators import blocks as B

    monkeypatch.setattr(B, "EDGES", 40)
    graph = random_graph(spark, n, m)
    want = rows(C.scc(graph), "id", "scc")
    for limit in (1, 30):
        found = C.scc(graph, max_edges=limit)
        assert rows(found, "id", "scc") == want and len(want) == found.count()


def test_components_without_joins(spark, monkeypatch):
    """A graph beyond a task's limit goes by blocks, not by joins of its edges."""
    monkeypatch.setattr(C, "colored_scc", lambda *_: pytest.fail("components by joins"))
    assert C.scc(random_graph(spark, 60, 300), max_edges=1).count() > 0


def test_components_without_a_distinct(spark, monkeypatch):
    """A table of many edges, few of them copies, isn't made distinct first; one of copies is. Loops and copies change nothing."""
    from tidegraph.operators import blocks as B
    from tidegraph.operators.iterate import checkpointed

    monkeypatch.setattr(B, "EDGES", 40)
    graph = random_graph(spark, 200, 260).select("src", "dest")
    odd = spark.createDataFrame([(3, 3), (3, 3), (500, 500), (600, 601), (601, 600)], "src long, dest long")
    few, many = checkpointed(graph.unionByName(odd).unionByName(graph.limit(20))), checkpointed(graph.unionByName(graph).unionByName(odd))
    want, made, pairs = rows(C.scc(few), "id", "scc"), [], C.pairs
    assert want == rows(C.colored_scc(few), "id", "scc") >= {(500, 500), (600, 600), (601, 600)}
    monkeypatch.setattr(C, "pairs", lambda edges: made.append(edges) or pairs(edges))
    for edges, distinct in ((few, 0), (many, 1), (few.filter("src is not null"), 1)):
        found = C.scc(edges, max_edges=1)
        assert rows(found, "id", "scc") == want and found.count() == len(want) and len(made) == distinct
        made.clear()
    monkeypatch.undo()


def test_parallel_edges_are_dealt_once(spark, monkeypatch):
    """Copies of an edge that carry no value are one before the shuffle; values are merged."""
    from tidegraph.operators import blocks as B

    edges = spark.createDataFrame([(0, 1, 2)] * 50 + [(0, 2, 1)], "part long, src long, dest long").coalesce(1)
    names, dealt, made = B.Names(np.zeros(2, np.int64), np.array([1, 2])), [], B.Blocks._made
    monkeypatch.setattr(B.Blocks, "_made", lambda self, out, merge: dealt.append(sum(len(r.s) // 4 for r in out.collect())) or made(self, out, merge))
    B.Blocks(edges, names)
    summed = B.Blocks(edges, names, lambda batch: np.ones(batch.num_rows), np.add, np.int64)
    assert dealt == [2, 51]
    at, value = summed.step(lambda own, s, first, x: (own, np.add.reduceat(x, first) if len(s) else x))
    assert dict(zip(at.tolist(), value.tolist())) == {0: 1, 1: 50}


def test_dag_without_joins(spark, toy):
    """Edges that leave their component: looked up by the workers they are those of joins, with parallel edges, ends that are null or in no component, and ids in any order."""
    more = spark.createDataFrame([(3, 4), (None, 1), (1, None), (77, 1), (1, 77)], "src long, dest long")
    graph = toy.select("src", "dest").unionByName(more)
    comps = C.scc(toy).orderBy(F.desc("id"))
    found = C.dag(graph, comps, max_edges=1)
    want = rows(C.dag(graph, comps), "cu", "cv")
    assert rows(found, "cu", "cv") == want == rows(C.dag(graph, comps, 1, 1), "cu", "cv") and len(want) == found.count() == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("HashAggregate") < plan.index("MapInArrow")  # what leaves is shuffled, not all edges
    assert C.dag(graph, comps.limit(0), max_edges=1).isEmpty()


@pytest.mark.parametrize("name", ["component_dag", "cac", "component_levels", "dag_indegree", "component_report", "cac_partition", "scc_dense", "scc_types", "scc", "scc_sizes"])
def test_component_queries_in_blocks(spark, monkeypatch, name):
    """Beyond a task's limit a query's rows are the same, and no step joins the edges."""
    from tidegraph.operators import blocks as B
    from tidegraph.plans.queries import QUERIES

    monkeypatch.setattr(B, "EDGES", 400)
    of = lambda: sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    want, blocked, used = of(), C.blocked_scc, []
    monkeypatch.setattr(C, "colored_scc", lambda *_: pytest.fail("components by joins"))
    monkeypatch.setattr(C, "blocked_scc", lambda *of: used.append(of) or blocked(*of))
    monkeypatch.setattr(C.scc, "__defaults__", (None, 1, B.MAX_VERTICES))
    monkeypatch.setattr(C.dag, "__defaults__", (1, B.MAX_VERTICES))
    assert of() == want and used


@pytest.mark.parametrize("name", ["cac", "component_levels", "dag_indegree", "component_report", "cac_partition", "scc_dense", "scc_types", "scc", "scc_sizes"])
def test_component_queries_without_a_distinct(spark, monkeypatch, name):
    """Beyond a task's limit a query deals its edges into blocks as they are: no step shuffles all pairs to make them distinct."""
    from tidegraph.operators import blocks as B
    from tidegraph.plans.queries import QUERIES

    monkeypatch.setattr(C, "pairs", lambda *_: pytest.fail("a distinct of all pairs"))
    monkeypatch.setattr(C.scc, "__defaults__", (None, 1, B.MAX_VERTICES))
    monkeypatch.setattr(C.dag, "__defaults__", (1, B.MAX_VERTICES))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_kway_in_blocks(spark, monkeypatch):
    """Swaps by blocks make the same moves as swaps by joins."""
    from tidegraph.operators import blocks as B

    monkeypatch.setattr(B, "EDGES", 40)
    graph = random_graph(spark, 60, 300)
    split = rows(S.kway(graph, 3, max_edges=1), "node", "part")
    assert len(split) == E.vertices(graph).count() and split == rows(S.kway(graph, 3, max_edges=1, max_vertices=1), "node", "part")


def test_seeds_in_blocks(spark, monkeypatch):
    """Who reaches a seed is found by blocks as by one task."""
    graph = random_graph(spark, 60, 100)
    power = I.power(graph).cache()
    want = rows(I.seeds(graph, power, 3), "pos", "id")
    monkeypatch.setattr(K, "MAX_EDGES", 1)
    monkeypatch.setattr(R, "frontier_bfs", lambda *_: pytest.fail("frontiers by joins"))
    assert rows(I.seeds(graph, power, 3), "pos", "id") == want and len(want) == 3


def test_reach_in_chunks(spark, monkeypatch):
    """Components are larger than a chunk of their members; zone sizes by blocks, in steps of 64 roots, are those of lists."""
    from tidegraph.operators import blocks as B

    monkeypatch.setattr(B, "EDGES", 40)
    monkeypatch.setattr(R, "CHUNK", 7)
    graph = random_graph(spark, 100, 200)
    every = E.vertices(graph)
    zones = R.bfs(graph, every).cache()
    pairs = R.reachability(graph)
    assert rows(pairs, "root", "node") == rows(zones, "root", "node") and pairs.count() == zones.count()
    short = lambda df: {(r.root, r.size, round(r.avg_dist, 9)) for r in df.collect()}
    assert short(R.zone_sizes(graph, every, 1, 1)) == short(R.zone_sizes(graph, every, 1)) == short(R.bfs_info(zones))


def test_sizes_by_targets(spark, monkeypatch):
    """All vertices' sizes come of bits of targets, in several ranges and rows of sums, as they come of lists; roots that no edge touches are alone."""
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (30, 40), (200, 300), (200, 1500)):
        s, d = np.unique(rng.integers(0, n, (2, m)), axis=1)
        starts, to = K.csr(n, s, d)
        order, *links = K.by_degree(starts, to)
        sums = np.sum([K.sums_to(*links, np.arange(a, min(n, a + 70))) for a in range(0, n, 70)], axis=0)
        assert sums.T.tolist() == [[len(x), x.sum()] for x in (K.distances(starts, to, int(r))[1] for r in order)]
    graph = random_graph(spark, 150, 300)
    every = E.vertices(graph)
    made, by = [], R._sizes_by_targets
    monkeypatch.setattr(R, "_sizes_by_targets", lambda *args: made.append(1) or by(*args))
    monkeypatch.setattr(R, "TARGET_WORDS", 1)
    monkeypatch.setattr(R, "SUMMED", 50)
    for roots in (every, every.filter("id % 3 > 0").union(spark.createDataFrame([(1000,)], "id long"))):
        got, want = ({(r.root, r.size, round(r.avg_dist, 9)) for r in df.collect()} for df in (R.zone_sizes(graph, roots), R.bfs_info(R.bfs(graph, roots))))
        assert got == want
    assert len(made) == 2


def test_ranks_in_pieces(spark, monkeypatch):
    """Ids and ranks of many edges go to the workers in pieces, none of which is large, and never as whole vectors through the driver; blocks without edges are there too."""
    from tidegraph.operators import blocks as B

    star = spark.createDataFrame([(i, 0, 1.0) for i in range(1, 200)] + [(0, 1, 1.0)], "src long, dest long, w double")
    rest = E.weighted(random_graph(spark, 60, 300), Weights()).select("src", "dest", "w")
    sub = star.withColumn("part", F.lit(7)).unionByName(rest.withColumn("part", F.lit(2))).cache()
    ends = RankOptions(max_iter=3), RankOptions(max_iter=0)
    want = [({(r.part, r.id): r.pr for r in P.pagerank(sub, o).collect()}, rows(P.convergence(sub, o), "part", "n_nodes", "n_steps", "converged")) for o in ends]
    monkeypatch.setattr(B, "EDGES", 40)
    monkeypatch.setattr(B, "PIECE", 100)
    for whole in ("names_of", "table"):
        monkeypatch.setattr(B, whole, lambda *_, **__: pytest.fail("a vector at the driver"))
    monkeypatch.setattr(B.Blocks, "step", lambda *_: pytest.fail("a vector at the driver"))
    sizes, relayed = [], B.relayed
    monkeypatch.setattr(B, "relayed", lambda table: [sizes.append(sum(len(x) for row in p.value for x in row if isinstance(x, bytes))) or p for p in relayed(table)])
    for o, (ranks, ended) in zip(ends, want, strict=True):
        assert {(r.part, r.id): r.pr for r in P.pagerank(sub, o, 1).collect()} == pytest.approx(ranks)
        assert rows(P.convergence(sub, o, 1), "part", "n_nodes", "n_steps", "converged") == ended
    assert len(sizes) > 20 and sorted(sizes)[len(sizes) // 2] < 400
