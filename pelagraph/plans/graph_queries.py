"""Algorithms over a small derived graph, whose rounds SQL can state one by one.

Vertices are the nations; an edge goes to each nation from which one buys more than 1.4 times the usual number of items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from pelagraph.operators import algorithms as alg
from pelagraph.session import GraphSession

TRADE = """t AS (SELECT c_nationkey AS x, s_nationkey AS y, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM t WHERE n > (SELECT 1.4 * avg(n) FROM t)), v AS (SELECT n_nationkey AS id FROM nation),
u AS MATERIALIZED (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y)"""
ROUNDS = 10


def trade(g: GraphSession) -> alg.Graph:
    t = g.cypher("MATCH (a:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:SOLD_BY]->(s:Supplier)-[:IN_NATION]->(b:Nation) RETURN a.n_nationkey AS src, b.n_nationkey AS dst, count(*) AS n")
    much = t.crossJoin(t.agg((F.avg("n") * 1.4).alias("least"))).where("n > least")  # one row
    return alg.Graph.of(g.catalog.node("Nation").df.select(F.col("n_nationkey").alias("id")), much)


def _chain(first: str, step: str, rounds: int) -> str:
    """r0 AS first, and each further round as step, in which {r} is the round before."""
    return ", ".join([f"r0 AS MATERIALIZED ({first})", *(f"r{i + 1} AS MATERIALIZED ({step.format(r=f'r{i}')})" for i in range(rounds))])


def pagerank_sql(edges: str, vertices: str, rounds: int) -> str:
    """edges: of CTEs that name e(x, y); vertices: a query of ids."""
    step = """SELECT r.id, 0.15 / n + 0.85 * (coalesce(g.s, 0) + coalesce(k.s, 0) / n) AS r FROM {r} r LEFT JOIN (SELECT e.y AS id, sum(q.r / d) AS s FROM {r} q JOIN e ON q.id = e.x JOIN deg ON deg.x = e.x GROUP BY 1) g ON r.id = g.id, nv, (SELECT sum(r) AS s FROM {r} WHERE id NOT IN (SELECT x FROM deg)) k"""
    chain = _chain("SELECT id, 1.0::DOUBLE / n AS r FROM vs, nv", step, rounds)
    return f"{edges}, vs AS ({vertices}), nv AS (SELECT count(*) AS n FROM vs), deg AS MATERIALIZED (SELECT x, count(*) AS d FROM e GROUP BY 1), {chain} SELECT id AS node, round(r, 9) AS rank FROM r{rounds}"


_WCC = f"WITH RECURSIVE {TRADE}, r AS (SELECT id AS x, id AS y FROM v UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x) SELECT x AS id, min(y) AS component_id FROM r GROUP BY 1"
#: Every vertex takes its neighbours' least label.
_LEAST = _chain("SELECT id, id AS l FROM v", "SELECT o.id, least(o.l, coalesce(m.l, o.l)) AS l FROM {r} o LEFT JOIN (SELECT u.x, min(q.l) AS l FROM u JOIN {r} q ON q.id = u.y GROUP BY 1) m ON m.x = o.id", 15)
#: A vertex's core number falls to the greatest h such that h neighbours have h or more, until none changes.
_CORE_ROUNDS = 60
_CORE = _chain(
    "SELECT id, count(y) AS c FROM v LEFT JOIN u ON u.x = id GROUP BY 1",
    "SELECT o.id, least(o.c, coalesce(h.h, o.c)) AS c FROM {r} o LEFT JOIN (SELECT x, max(least(c, upto)) AS h FROM (SELECT u.x, n.c, count(*) OVER (PARTITION BY u.x ORDER BY n.c DESC) AS upto FROM u JOIN {r} n ON u.y = n.id) GROUP BY 1) h ON h.x = o.id",
    _CORE_ROUNDS,
)
_LABELS = _chain(
    "SELECT id, id AS l FROM v",
    """SELECT o.id, coalesce(b.l, o.l) AS l FROM {r} o LEFT JOIN (SELECT x, l FROM (SELECT w.x, w.l, row_number() OVER (PARTITION BY w.x ORDER BY w.n DESC, (w.l <> m.l)::INT, w.l) AS i FROM
(SELECT b.x, n.l, count(*) AS n FROM (SELECT x, y FROM e WHERE x <> y UNION ALL SELECT y, x FROM e WHERE x <> y) b JOIN {r} n ON b.y = n.id GROUP BY 1, 2) w JOIN {r} m ON m.id = w.x) WHERE i = 1) b ON b.x = o.id""",
    ROUNDS,
)
_FOREST = f"""WITH RECURSIVE {TRADE}, r AS (SELECT id AS x, id AS y FROM v UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x), c AS (SELECT x, min(y) AS root FROM r GROUP BY 1),
w AS (SELECT x AS k, 0 AS d FROM c WHERE x = root UNION SELECT u.y, d + 1 FROM w JOIN u ON w.k = u.x WHERE d < 25), b AS (SELECT k, min(d) AS d FROM w GROUP BY 1)
SELECT min(p.k) AS src_id, q.k AS dst_id FROM b q JOIN u ON u.y = q.k JOIN b p ON p.k = u.x AND p.d = q.d - 1 GROUP BY q.k"""


def _whole_table(text: Callable[..., None], edges: str) -> None:
    """The same over the whole co-ordering graph; its diameter and its rounds to the last core number are far below the SQL's."""
    base = f"{edges}, v AS (SELECT p_partkey AS id FROM part), u AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e)"
    text("algo_wcc", "CALL wcc('CO_ORDERED') YIELD node, component_id RETURN node, component_id", f"{base}, {_LEAST} SELECT id AS node, l AS component_id FROM r15")
    text("algo_kcore", "CALL kcore('CO_ORDERED') YIELD node, core_number RETURN node, core_number", f"{base}, {_CORE} SELECT id AS node, c AS core_number FROM r{_CORE_ROUNDS}")
    text("algo_louvain", "CALL louvain('CO_ORDERED') YIELD node, community_id RETURN node, community_id", f"{base}, {_LABELS} SELECT id AS node, dense_rank() OVER (ORDER BY l) - 1 AS community_id FROM r{ROUNDS}")
    text("algo_spanning_forest", "CALL spanning_forest('CO_ORDERED') YIELD src_id, dst_id RETURN src_id, dst_id",
         f"{base}, {_LEAST}, w AS (SELECT id AS k, 0 AS d FROM r15 WHERE id = l UNION SELECT u.y, d + 1 FROM w JOIN u ON w.k = u.x WHERE d < 12), b AS (SELECT k, min(d) AS d FROM w GROUP BY 1) SELECT min(p.k) AS src_id, q.k AS dst_id FROM b q JOIN u ON u.y = q.k JOIN b p ON p.k = u.x AND p.d = q.d - 1 GROUP BY q.k")


def register(text: Callable[..., None], code: Callable[..., Callable], edges: str) -> None:
    _whole_table(text, edges)
    code("algo_wcc_trade", _WCC)(lambda g: alg.wcc(trade(g)))
    code("algo_kcore_trade", f"WITH {TRADE}, {_CORE} SELECT id, c AS core_number FROM r{_CORE_ROUNDS}")(lambda g: alg.kcore(trade(g)))
    code("algo_louvain_trade", f"WITH {TRADE}, {_LABELS} SELECT id, dense_rank() OVER (ORDER BY l) - 1 AS community_id FROM r{ROUNDS}")(lambda g: alg.label_propagation(trade(g), ROUNDS))
    code("algo_spanning_forest_trade", _FOREST)(lambda g: alg.spanning_forest(trade(g)))
    code("algo_pagerank_trade", pagerank_sql(f"WITH {TRADE}", "SELECT id FROM v", 20))(lambda g: alg.pagerank(trade(g), tolerance=0.0).select(F.col("id").alias("node"), F.round("rank", 9).alias("rank")))
    text("algo_pagerank", "CALL pagerank('CO_ORDERED', 20, 0.85, 0.0) YIELD node, rank RETURN node, round(rank, 9) AS rank", pagerank_sql(edges, "SELECT p_partkey AS id FROM part", 20))
    distance = f"{edges}, w AS (SELECT 1::BIGINT AS node, 0 AS d UNION SELECT e.y, d + 1 FROM w JOIN e ON w.node = e.x WHERE d < 12), m AS (SELECT node, min(d) AS d FROM w GROUP BY 1)"
    text(
        "gds_scalars",
        "CALL has_path('CO_ORDERED', 1, 40) YIELD has_path AS p CALL shortest_path_length('CO_ORDERED', 1, 40) YIELD length AS l CALL sssp_distance('CO_ORDERED', 1, 50) YIELD length AS s CALL k_hop_count('CO_ORDERED', 1, 2) YIELD count AS k "
        "CALL clear_gds_cache() YIELD result AS c RETURN p, l, s, k, gds_version() AS v",
        f"{distance} SELECT EXISTS (SELECT 1 FROM m WHERE node = 40 AND d <= 10) AS p, (SELECT d::DOUBLE FROM m WHERE node = 40) AS l, (SELECT d::DOUBLE FROM m WHERE node = 50) AS s, (SELECT count(*) FROM m WHERE d BETWEEN 1 AND 2) AS k, '0.1' AS v",
    )
    text("gds_component_and_score", "CALL wcc_component('CO_ORDERED', 5) YIELD component_id AS c CALL pagerank_score('CO_ORDERED', 5) YIELD rank AS r RETURN c, r > 0 AS ranked",
         f"{edges}, u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), w AS (SELECT 5::BIGINT AS k UNION SELECT u.y FROM w JOIN u ON w.k = u.x) SELECT min(k) AS c, true AS ranked FROM w")
    text("algo_delta_stepping", "CALL delta_stepping('CO_ORDERED', 1) YIELD node, distance WHERE distance IS NOT NULL RETURN node, distance", f"{distance} SELECT node, d::DOUBLE AS distance FROM m")

