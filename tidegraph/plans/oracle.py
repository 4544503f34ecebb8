"""DuckDB SQL for the queries of `queries`, written independently of the operators."""

from __future__ import annotations

_OCC = "row_number() OVER (PARTITION BY src, dest, likes, shares, comments)"
_W = "CAST((o_orderkey // 8) % 6 AS INTEGER) AS likes, CAST((o_orderkey // 48) % 4 AS INTEGER) AS shares, CAST((o_orderkey // 192) % 3 AS INTEGER) AS comments"
LINK = f"g0 AS (SELECT o_custkey AS src, (o_custkey * 31 + o_orderkey * 17) % (SELECT count(*) FROM customer) AS dest, {_W} FROM orders), g AS (SELECT *, CAST({_OCC} AS INTEGER) AS occ FROM g0)"
TRADE = f"""t0 AS (SELECT o_custkey AS c, 1000000 + l_suppkey AS s, CAST(l_quantity AS INTEGER) AS likes, l_linenumber AS shares, l_returnflag = 'R' AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g0 AS (SELECT c AS src, s AS dest, likes, shares, 0 AS comments FROM t0 UNION ALL SELECT s, c, likes, shares, 1 FROM t0 WHERE back), g AS (SELECT *, CAST({_OCC} AS INTEGER) AS occ FROM g0)"""
DENSE = f"g0 AS (SELECT * FROM (SELECT lag(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS src, o_custkey AS dest, {_W} FROM orders) WHERE src IS NOT NULL), g AS (SELECT *, CAST({_OCC} AS INTEGER) AS occ FROM g0)"
E = "e AS (SELECT DISTINCT src, dest FROM g), v AS (SELECT src AS id FROM g UNION SELECT dest FROM g)"
DEG = "deg AS (SELECT id, (SELECT count(*) FROM e WHERE dest = id) AS fin, (SELECT count(*) FROM e WHERE src = id) AS fout FROM v)"
IDX = "ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM v)"
REACH = "r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, e.dest FROM r JOIN e ON r.b = e.src)"
SCC = "comp AS (SELECT x.a AS id, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
DAG = "dag AS (SELECT DISTINCT a.scc AS cu, b.scc AS cv FROM e JOIN comp a ON src = a.id JOIN comp b ON dest = b.id WHERE a.scc <> b.scc)"
LEVEL = "l(c, lv) AS (SELECT scc, 1 FROM comp UNION SELECT d.cv, lv + 1 FROM l JOIN dag d ON l.c = d.cu), lvl AS (SELECT c AS scc, CAST(max(lv) AS BIGINT) AS level FROM l GROUP BY c)"
INDEG = "ind AS (SELECT c.scc, count(cu) AS indeg FROM (SELECT DISTINCT scc FROM comp) c LEFT JOIN dag ON cv = c.scc GROUP BY c.scc)"
CAC = "k(scc, cac) AS (SELECT scc, scc FROM ind WHERE indeg <> 1 UNION SELECT i.scc, k.cac FROM k JOIN dag ON cu = k.scc JOIN ind i ON i.scc = cv WHERE i.indeg = 1)"
LPT = """tree AS (SELECT cac, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cac) AS rn FROM k GROUP BY cac),
lpt(rn, part, loads) AS (SELECT CAST(0 AS BIGINT), 0, CAST([0, 0, 0] AS BIGINT[]) UNION ALL
  SELECT t.rn, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + t.n ELSE x END) FROM lpt JOIN tree t ON t.rn = lpt.rn + 1)"""
POWER = """own AS (SELECT id, fin, CASE WHEN fout > 0 THEN 1 ELSE 0 END AS s FROM deg),
pow AS (SELECT r.a AS id, idx, 0.15::DOUBLE * CAST(sum(fin) AS DOUBLE) / (SELECT count(*) FROM v) + 0.85::DOUBLE * CAST(sum(s) AS DOUBLE) AS power FROM r JOIN own ON r.b = own.id JOIN ix ON ix.id = r.a GROUP BY r.a, idx),
cand AS (SELECT * FROM pow ORDER BY round(power, 10) DESC, idx DESC LIMIT (SELECT greatest(1, count(*) // 5) FROM v))"""
RW = "0.1::DOUBLE * likes + 0.5::DOUBLE * shares + 0.8::DOUBLE * comments"
CW = "0.02::DOUBLE * likes + 0.03::DOUBLE * shares + 0.05::DOUBLE * comments"


ZONES = "z(root, node, dist) USING KEY (root, node) AS (SELECT id, id, CAST(0 AS BIGINT) FROM v{} UNION SELECT z.root, e.dest, min(z.dist + 1) FROM z JOIN e ON e.src = z.node LEFT JOIN recurring.z AS o ON o.root = z.root AND o.node = e.dest WHERE o.root IS NULL GROUP BY z.root, e.dest)"


def _sub(w: str) -> str:
    return f"""sub AS (SELECT DISTINCT part, src, dest, likes, shares, comments, occ, {w} AS w FROM
  (SELECT CAST(src % 3 AS INTEGER) AS part, * FROM g UNION ALL SELECT CAST(dest % 3 AS INTEGER) AS part, * FROM g))"""


#: Vertices, edges between sources, and out-weights of every part.
_NODES = """nd AS (SELECT part, src AS id, count(*) OVER (PARTITION BY part) AS n FROM (SELECT DISTINCT part, src FROM sub)),
eff AS (SELECT s.* FROM sub s JOIN nd ON nd.part = s.part AND nd.id = s.dest),
ow AS (SELECT part, src, sum(w) AS out_w FROM eff GROUP BY part, src), p0 AS (SELECT part, id, n, 1.0::DOUBLE / n AS pr FROM nd)"""
#: PageRank until a part's summed change is below 1e-4, 100 steps at most.
CONVERGED = """it(step, part, id, n, pr, moved) AS (SELECT 0, part, id, n, pr, 1e9::DOUBLE FROM p0 UNION ALL
  SELECT step + 1, part, id, n, new, sum(abs(new - pr)) OVER (PARTITION BY part) FROM (SELECT i.step, i.part, i.id, i.n, i.pr, 0.15::DOUBLE / i.n + 0.85::DOUBLE * coalesce(x.got, 0.0) AS new
    FROM it i LEFT JOIN (SELECT eff.part, eff.dest, sum(q.pr * eff.w / out_w) AS got FROM eff JOIN ow ON ow.part = eff.part AND ow.src = eff.src JOIN it q ON q.part = eff.part AND q.id = eff.src WHERE out_w > 0 GROUP BY eff.part, eff.dest) x
    ON x.part = i.part AND x.dest = i.id WHERE i.moved >= 1e-4 AND i.step < 100)),
fin AS (SELECT * FROM it QUALIFY step = max(step) OVER (PARTITION BY part))"""


def _ranks(steps: int = 5, own: str = "id % 3 = part") -> str:
    out = _NODES
    for i in range(1, steps + 1):
        out += f""", p{i} AS (SELECT nd.part, nd.id, nd.n, 0.15::DOUBLE / nd.n + 0.85::DOUBLE * coalesce(x.got, 0.0) AS pr FROM nd LEFT JOIN
  (SELECT eff.part, eff.dest, sum(q.pr * eff.w / out_w) AS got FROM eff JOIN ow ON ow.part = eff.part AND ow.src = eff.src JOIN p{i - 1} q ON q.part = eff.part AND q.id = eff.src WHERE out_w > 0 GROUP BY eff.part, eff.dest) x ON x.part = nd.part AND x.dest = nd.id)"""
    return out + """, top AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY round(pr, 10) DESC, id) AS pos, id, pr FROM p5 WHERE """ + own + ")"


GREEDY = """e0 AS (SELECT DISTINCT src, dest FROM sub WHERE part = 0), pool AS (SELECT id, min((part, pos)) AS place FROM top WHERE pos <= 5 GROUP BY id),
z(root, node) AS (SELECT id, id FROM pool UNION SELECT z.root, e0.dest FROM z JOIN e0 ON e0.src = z.node),
zs AS (SELECT root AS id, count(*) AS spread FROM z GROUP BY root),
best AS (SELECT row_number() OVER (ORDER BY spread DESC, place) AS pos, id, spread FROM pool JOIN zs USING (id) ORDER BY spread DESC, place LIMIT 5)"""


def _live(rows: str) -> str:
    fifth = "({0} * {0} % 2147483647) AS {0}2, ({0}2 * {0}2 % 2147483647) AS {0}4, ({0}4 * {0} % 2147483647) * 48271 % 2147483647 AS {1}"
    of = {"CAST(part AS BIGINT)": 1540483477, "CAST(src AS BIGINT)": 1566083941, "CAST(dest AS BIGINT)": 1664525, "CAST(likes AS BIGINT)": 22695477, "CAST(shares AS BIGINT)": 1103515245, "CAST(comments AS BIGINT)": 134775813, "CAST(occ AS BIGINT)": 69069}
    key = " + ".join(f"{c} * {factor} % 2147483647" for c, factor in of.items())
    return f"""keyed AS (SELECT part, src, dest, w, (42 + {key}) % 2147483647 AS x, {fifth.format("x", "k")} FROM (SELECT * FROM {rows} WHERE w > 0)),
coins AS (SELECT t.trial, part, src, dest, w, (k + (t.trial + 1) * 16807) % 2147483647 AS y, {fifth.format("y", "z")}, z / 2147483647.0::DOUBLE AS u FROM keyed, (SELECT CAST(unnest(range(20)) AS BIGINT) AS trial) t),
live AS (SELECT DISTINCT trial, part, src, dest FROM coins WHERE u < w)"""


IC = f"wg AS (SELECT CAST(0 AS INTEGER) AS part, *, {CW} AS w FROM g), " + _live("wg")
IC_RUN = "sd AS (SELECT DISTINCT src AS id FROM g ORDER BY src LIMIT 3), a(trial, node) AS (SELECT trial, id FROM sd, (SELECT unnest(range(20)) AS trial) UNION SELECT a.trial, live.dest FROM a JOIN live ON live.trial = a.trial AND live.src = a.node), act AS (SELECT CAST(0 AS INTEGER) AS part, CAST(trial AS INTEGER) AS trial, count(*) AS active FROM a GROUP BY trial)"
LINES = """ln AS (SELECT src, concat_ws(' ', src, dest, likes, shares, comments) AS row, concat_ws('|', lpad(CAST(src AS VARCHAR), 12, '0'), lpad(CAST(dest AS VARCHAR), 12, '0'), lpad(CAST(likes AS VARCHAR), 12, '0'), lpad(CAST(shares AS VARCHAR), 12, '0'), lpad(CAST(comments AS VARCHAR), 12, '0'), lpad(CAST(occ AS VARCHAR), 12, '0')) AS n, src % 11 AS m, * EXCLUDE (src) FROM g),
ok AS (SELECT * FROM ln WHERE m NOT IN (3, 4, 5))"""


def _q(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


_base = (LINK, E)
_comp = (*_base, REACH, SCC, DAG)
_pow = (*_base, DEG, IDX, REACH, POWER)
_pr = (TRADE, _sub(RW), _ranks())
_pr_cast = (TRADE, _sub(CW), _ranks())
SQL = {
    "scan_edgelist": _q("SELECT src, dest, likes, shares, comments FROM ok ORDER BY n LIMIT 250000", LINK, LINES),
    "scan_edgelist_weighted": _q(f"SELECT DISTINCT ON (part, src, dest, likes, shares, comments, occ) part, src, dest, round({RW}, 8) AS w FROM (SELECT CAST(src % 3 AS INTEGER) AS part, * FROM ok UNION ALL SELECT CAST(dest % 3 AS INTEGER) AS part, * FROM ok)", LINK, LINES),
    "scan_triples": _q("SELECT src, dest, CAST(likes AS DOUBLE) AS w FROM g WHERE src % 5 <> 0", LINK),
    "scan_metis": _q("SELECT src, dest FROM g WHERE src <> dest UNION SELECT dest, src FROM g WHERE src <> dest", LINK),
    "metis_header": _q("SELECT (SELECT max(id) + 1 FROM v) AS n_vertices, count(*) AS n_edges, (SELECT max(id) + 1 FROM v) AS n_lines, 2 * count(*) AS degrees, true AS consistent FROM (SELECT DISTINCT least(src, dest) AS a, greatest(src, dest) AS b FROM g WHERE src <> dest)", *_base),
    "scan_partitions": _q("SELECT CAST(id % 3 AS INTEGER) AS part, id AS node FROM v", *_base),
    "edge_filter_valid": _q("SELECT src - 100 AS src, dest, likes, shares, comments, occ FROM g WHERE src >= 100", LINK),
    "edge_quality": _q("SELECT count(*) AS n_edges, count(*) FILTER (src < 100) AS n_bad_ids, count(*) FILTER (likes < 1) AS n_negative, count(*) FILTER (src - 100 = dest) AS n_loops FROM g", LINK),
    "edge_weight": _q(f"SELECT src, dest, occ, round({RW}, 8) AS w FROM g", TRADE),
    "edge_dedup": _q("SELECT * FROM e", DENSE, E),
    "vertex_set": _q("SELECT * FROM v", DENSE, E),
    "vertex_index": _q("SELECT * FROM ix", *_base, IDX),
    "dense_vertices": _q("SELECT unnest(range((SELECT max(id) + 1 FROM v))) AS id", *_base),
    "followers_followees": _q("SELECT id, fin AS followers, fout AS followees FROM deg", DENSE, E, DEG),
    "psi": _q("SELECT src, dest, round(1.0::DOUBLE / fout, 8) AS psi FROM e JOIN deg ON src = id", *_base, DEG),
    "influence_score": _q("SELECT id, round(0.15::DOUBLE * fin / (SELECT count(*) FROM v) + 0.85::DOUBLE * CASE WHEN fout > 0 THEN 1 ELSE 0 END, 8) AS score FROM deg", *_base, DEG),
    "influence_ranking": _q("SELECT row_number() OVER (ORDER BY round(s, 10) DESC, id DESC) AS place, id, round(s, 8) AS score FROM (SELECT id, 0.15::DOUBLE * fin / (SELECT count(*) FROM v) + 0.85::DOUBLE * CASE WHEN fout > 0 THEN 1 ELSE 0 END AS s FROM deg)", *_base, DEG),
    "subgraph_extract": _q("SELECT part, src, dest, likes, shares, comments, occ FROM sub", TRADE, _sub(RW)),
    "ghost_nodes": _q("SELECT DISTINCT part, node FROM (SELECT part, src AS node FROM sub UNION SELECT part, dest FROM sub) WHERE node % 3 <> part", TRADE, _sub(RW)),
    "subgraph_stats": _q("SELECT s.part, n_edges, coalesce(n_ghosts, 0) AS n_ghosts FROM (SELECT part, count(*) AS n_edges FROM sub GROUP BY part) s LEFT JOIN (SELECT part, count(DISTINCT node) AS n_ghosts FROM (SELECT part, src AS node FROM sub UNION SELECT part, dest FROM sub) WHERE node % 3 <> part GROUP BY part) USING (part)", TRADE, _sub(RW)),
    "reachability": _q("SELECT a AS root, b AS node FROM r", *_base, REACH),
    "bfs_zone": _q("SELECT root, node, dist FROM z", *_base, ZONES.format(" WHERE id % 20 = 0")),
    "bfs_info": _q("SELECT root, count(*) AS size, round(CAST(sum(dist) AS DOUBLE) / count(*), 8) AS avg_dist FROM z GROUP BY root", *_base, ZONES.format("")),
    "scc": _q("SELECT * FROM comp", *_base, REACH, SCC),
    "scc_dense": _q("SELECT d.id, coalesce(scc, d.id) AS scc FROM (SELECT unnest(range((SELECT max(id) + 1 FROM v))) AS id) d LEFT JOIN comp ON comp.id = d.id", *_base, REACH, SCC),
    "scc_types": _q("SELECT id, scc, CASE WHEN count(*) OVER (PARTITION BY scc) > 1 THEN 's' ELSE 'c' END AS type FROM comp", *_base, REACH, SCC),
    "scc_sizes": _q("SELECT scc, count(*) AS size FROM comp GROUP BY scc", *_base, REACH, SCC),
    "component_dag": _q("SELECT * FROM dag", *_comp),
    "dag_indegree": _q("SELECT * FROM ind", *_comp, INDEG),
    "component_levels": _q("SELECT * FROM lvl", *_comp, LEVEL),
    "topo_levels": _q("SELECT scc, level, row_number() OVER (ORDER BY level, scc) AS pos FROM lvl", *_comp, LEVEL),
    "component_report": _q("SELECT scc, count(*) AS size, CASE WHEN count(*) > 1 THEN 's' ELSE 'c' END AS type, any_value(level) AS level, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM comp JOIN lvl USING (scc) GROUP BY scc", *_comp, LEVEL),
    "component_summary": _q("SELECT count(*) AS components, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS scc_vertices, count(*) FILTER (n = 1) AS cac_vertices, count(*) FILTER (n > 1) AS scc_components, count(*) FILTER (n = 1) AS cac_components FROM (SELECT count(*) AS n FROM comp GROUP BY scc)", *_base, REACH, SCC),
    "cac": _q("SELECT * FROM k", *_comp, INDEG, CAC),
    "cac_partition": _q("SELECT part, comp.id AS node FROM comp JOIN k USING (scc) JOIN tree USING (cac) JOIN lpt ON lpt.rn = tree.rn", *_comp, INDEG, CAC, LPT),
    "partition_write_roundtrip": _q("SELECT part, comp.id AS node FROM comp JOIN k USING (scc) JOIN tree USING (cac) JOIN lpt ON lpt.rn = tree.rn", *_comp, INDEG, CAC, LPT),
    "kway_partition": _q("SELECT count(*) AS n_vertices, count(DISTINCT id) AS n_distinct, CAST(3 AS BIGINT) AS n_parts, true AS balanced FROM v", *_base),
    "edge_cut": _q("SELECT count(*) AS n_edges, count(*) FILTER (a % 3 <> b % 3) AS cut FROM (SELECT DISTINCT least(src, dest) AS a, greatest(src, dest) AS b FROM g WHERE src <> dest)", LINK),
    "influence_power": _q("SELECT id, round(power, 8) AS power FROM pow", *_pow),
    "seed_candidates": _q("SELECT id, idx, round(power, 8) AS power FROM cand", *_pow),
    "pr_effective_edges": _q("SELECT part, src, dest, occ, round(w, 8) AS w FROM eff", *_pr),
    "out_weight": _q("SELECT part, src, round(out_w, 8) AS out_w FROM ow", *_pr),
    "local_pagerank": _q("SELECT part, id, round(pr, 8) AS pr FROM p5", *_pr),
    "pagerank_converged": _q("SELECT part, id, round(pr, 7) AS pr FROM fin", TRADE, _sub(RW), _NODES, CONVERGED),
    "pagerank_convergence": _q("SELECT part, count(*) AS n_nodes, CAST(max(step) AS INTEGER) AS n_steps, max(moved) < 1e-4 AS converged FROM fin GROUP BY part", TRADE, _sub(RW), _NODES, CONVERGED),
    "run_metrics": _q("SELECT part, n_edges, n_ghosts, n_ranked, n_steps, converged FROM (SELECT part, count(*) AS n_edges FROM sub GROUP BY part) JOIN (SELECT part, count(DISTINCT node) AS n_ghosts FROM (SELECT part, src AS node FROM sub UNION SELECT part, dest FROM sub) WHERE node % 3 <> part GROUP BY part) USING (part) JOIN (SELECT part, count(*) AS n_ranked, CAST(max(step) AS INTEGER) AS n_steps, max(moved) < 1e-4 AS converged FROM fin GROUP BY part) USING (part)", TRADE, _sub(RW), _NODES, CONVERGED),
    "local_pagerank_topk": _q("SELECT part, CAST(pos AS INTEGER) AS pos, id, round(pr, 8) AS pr FROM top WHERE pos <= 5", *_pr),
    "candidate_pool": _q("SELECT part, CAST(pos AS INTEGER) AS pos, id FROM top WHERE pos <= 3", *_pr),
    "greedy_seeds": _q("SELECT CAST(pos AS INTEGER) AS pos, id, spread FROM best", *_pr, GREEDY),
    "ic_live_edges": _q("SELECT CAST(trial AS INTEGER) AS trial, count(*) AS n_live FROM coins WHERE u < w GROUP BY trial", TRADE, IC),
    "ic_spread": _q("SELECT * FROM act", TRADE, IC, IC_RUN),
    "ic_total": _q("SELECT CAST(sum(active) AS BIGINT) AS total, CAST(sum(active) AS DOUBLE) / 20 AS mean_spread FROM act", TRADE, IC, IC_RUN),
}
_ACTIVE = "a(trial, part, node) AS (SELECT trial, part, id FROM best, (SELECT unnest(range(20)) AS trial), (SELECT unnest(range({})) AS part) UNION SELECT a.trial, a.part, live.dest FROM a JOIN live ON live.trial = a.trial AND live.part = a.part AND live.src = a.node)"
_TOTAL = "SELECT CAST(pos AS INTEGER) AS pos, id, spread, t.* FROM best, (SELECT count(*) AS total, count(*) / 20.0::DOUBLE AS mean_spread FROM a) t"
SQL["pipeline_report"] = _q(_TOTAL, *_pr_cast, GREEDY, _live("sub"), _ACTIVE.format(3))
SQL["pipeline_report_global"] = _q(_TOTAL, TRADE, f"sub AS (SELECT CAST(0 AS INTEGER) AS part, *, {CW} AS w FROM g)", _ranks(own="true"), GREEDY, _live("sub"), _ACTIVE.format(1))
_s = "SELECT r.a AS id, sum(0.15::DOUBLE * fin / (SELECT count(*) FROM v) + 0.85::DOUBLE * s) AS gone FROM r JOIN own ON own.id = r.b WHERE r.b IN (SELECT id FROM {0}) GROUP BY r.a"
_pick = "{1} AS (SELECT * FROM {0} UNION ALL SELECT * FROM (SELECT {2} AS pos, c.id FROM cand c LEFT JOIN (" + _s + ") x ON x.id = c.id WHERE c.id NOT IN (SELECT id FROM {0}) ORDER BY round(power - coalesce(gone, 0.0) - idx * 1e-9::DOUBLE, 10), idx LIMIT 1))"
_PICKED = ("SELECT CAST(pos AS INTEGER) AS pos, id FROM s3", "s0 AS (SELECT 0 AS pos, id FROM cand WHERE false)", *[_pick.format(f"s{i}", f"s{i + 1}", i + 1) for i in range(3)])
SQL["seed_select"] = _q(_PICKED[0], *_pow, *_PICKED[1:])
SQL["influential"] = _q(_PICKED[0], DENSE, *_pow[1:], *_PICKED[1:])
