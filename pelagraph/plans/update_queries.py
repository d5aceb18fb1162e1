"""Updates, each followed by a reading of what it has left, and files written and read back; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from pelagraph.session import GraphSession
from pelagraph.storage import shared_dir

_LINES = "MATCH (o:Order)-[r:HAS_PART]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, r.l_linenumber AS n, r.l_quantity AS q"
_line = "l_orderkey AS o, l_partkey AS p, l_linenumber AS n"

QUERIES: dict[str, tuple[str, str]] = {
    "update_set_parallel": (
        f"MATCH (o:Order)-[r:HAS_PART]->(p:Part) WHERE r.l_quantity > 25 SET r.l_quantity = 0 - r.l_quantity;; {_LINES}",
        f"SELECT {_line}, CASE WHEN l_quantity > 25 THEN -l_quantity ELSE l_quantity END AS q FROM lineitem",
    ),
    "update_delete_parallel": (
        f"MATCH (o:Order)-[r:HAS_PART]->(p:Part) WHERE r.l_quantity > 25 AND p.p_size > 10 DELETE r;; {_LINES}",
        f"SELECT {_line}, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT (l_quantity > 25 AND p_size > 10)",
    ),
    "update_merge_rel_properties": (
        f"MATCH (o:Order)-[x:HAS_PART]->(p:Part) WHERE x.l_linenumber = 2 MERGE (o)-[r:HAS_PART {{l_linenumber: 1}}]->(p) ON CREATE SET r.l_quantity = -1.0 ON MATCH SET r.l_quantity = -2.0;; {_LINES}",
        f"""WITH two AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 2)
SELECT {_line}, CASE WHEN l_linenumber = 1 AND EXISTS (SELECT 1 FROM two t WHERE t.l_orderkey = l.l_orderkey AND t.l_partkey = l.l_partkey) THEN -2.0 ELSE l_quantity END AS q FROM lineitem l
UNION ALL SELECT l_orderkey, l_partkey, 1, -1.0 FROM two t WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE t.l_orderkey = l.l_orderkey AND t.l_partkey = l.l_partkey AND l_linenumber = 1)""",
    ),
    "update_merge_rel_return": (
        "MATCH (n:Nation), (r:Region) WHERE n.n_regionkey = r.r_regionkey OR r.r_regionkey = 0 MERGE (n)-[x:IN_REGION]->(r) RETURN n.n_nationkey AS n, type(x) AS t, end_node(x) AS r",
        "SELECT n_nationkey AS n, 'IN_REGION' AS t, r_regionkey::VARCHAR AS r FROM nation, region WHERE n_regionkey = r_regionkey OR r_regionkey = 0",
    ),
    "update_merge_pattern": (
        "UNWIND [0, 1, 1, 90] AS i MERGE (n:Nation {n_nationkey: 900 + i})-[x:IN_REGION]->(r:Region {r_regionkey: i}) ON CREATE SET n.n_name = 'MADE' ON MATCH SET n.n_name = 'FOUND';; "
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_nationkey AS n, n.n_name AS name, r.r_regionkey AS r",
        "SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation UNION ALL VALUES (900, 'MADE', 0), (901, 'MADE', 1), (990, 'MADE', 90)",
    ),
    "update_merge_twice": (
        "MERGE (n:Nation {n_nationkey: 900})-[:IN_REGION]->(r:Region {r_regionkey: 2});; MERGE (n:Nation {n_nationkey: 900})-[:IN_REGION]->(r:Region {r_regionkey: 2}) ON MATCH SET n.n_name = 'AGAIN';; "
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE n.n_nationkey > 20 RETURN n.n_nationkey AS n, n.n_name AS name, r.r_name AS r",
        "SELECT n_nationkey AS n, n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 20 UNION ALL SELECT 900, 'AGAIN', r_name FROM region WHERE r_regionkey = 2",
    ),
    "update_merge_by_row": (
        "MATCH (c:Customer) WHERE c.c_acctbal > 9000 MERGE (n:Nation {n_nationkey: c.c_nationkey + 20}) ON CREATE SET n.n_regionkey = c.c_nationkey ON MATCH SET n.n_name = 'HAD';; MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.n_regionkey AS r",
        """WITH w AS (SELECT DISTINCT c_nationkey + 20 AS k FROM customer WHERE c_acctbal > 9000)
SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT k FROM w) THEN 'HAD' ELSE n_name END AS name, n_regionkey AS r FROM nation
UNION ALL SELECT k, NULL, k - 20 FROM w WHERE k NOT IN (SELECT n_nationkey FROM nation)""",
    ),
    "update_set_bag": (
        "MATCH (p:Part) WHERE p.p_size > 40 SET p = {p_name: concat(p.p_name, '!'), p_size: p.p_size + 1};; MATCH (p:Part) RETURN p.*",
        "SELECT p_partkey, p_name || CASE WHEN p_size > 40 THEN '!' ELSE '' END AS p_name, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part",
    ),
    "update_set_bag_added": (
        "MATCH (p:Part) WHERE p.p_size > 40 SET p += {p_name: 'big', p_size: 0};; MATCH (p:Part) RETURN p.*",
        "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_name END AS p_name, p_brand, p_type, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size, p_retailprice FROM part",
    ),
    "update_set_bag_rel": (
        f"MATCH (o:Order)-[r:HAS_PART]->(p:Part) WHERE r.l_linenumber = 1 SET r = {{l_linenumber: 7, l_quantity: r.l_quantity * 2}};; {_LINES}",
        "SELECT l_orderkey AS o, l_partkey AS p, CASE WHEN l_linenumber = 1 THEN 7 ELSE l_linenumber END AS n, CASE WHEN l_linenumber = 1 THEN l_quantity * 2 ELSE l_quantity END AS q FROM lineitem",
    ),
    "update_set_return": (
        "MATCH (p:Part) WHERE p.p_size > 40 SET p.p_size = p.p_size * 2, p.p_retailprice = p.p_size RETURN p.p_partkey AS k, p.p_size AS s, p.p_retailprice AS r",
        "SELECT p_partkey AS k, p_size * 2 AS s, (p_size * 2)::DOUBLE AS r FROM part WHERE p_size > 40",
    ),
    "update_set_rel_return": (
        "MATCH (o:Order)-[r:HAS_PART]->(p:Part) WHERE r.l_linenumber = 3 WITH r AS x, o SET x.l_tax = 1.5 RETURN o.o_orderkey AS o, x.l_tax AS t, x.l_linenumber AS n",
        "SELECT l_orderkey AS o, 1.5::DOUBLE AS t, l_linenumber AS n FROM lineitem WHERE l_linenumber = 3",
    ),
    "update_set_key": (
        "MATCH (n:Nation) WHERE n.n_nationkey < 3 SET n.n_nationkey = n.n_nationkey + 1000;; MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, count(*) AS n",
        "SELECT n_nationkey + CASE WHEN n_nationkey < 3 THEN 1000 ELSE 0 END AS k, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    ),
    "update_delete_connected": (
        "MATCH (n:Nation) WHERE n.n_regionkey = 1 DELETE n;; MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN n.n_nationkey AS k, count(*) AS n",
        "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 GROUP BY 1",
    ),
    "update_create_path": (
        "CREATE (n:Nation {n_nationkey: 900, n_name: 'NEW'})-[x:IN_REGION]->(r:Region {r_regionkey: 90, r_name: 'FAR'}) RETURN n.n_name AS n, type(x) AS t, r.r_name AS r, n.n_regionkey AS none",
        "SELECT 'NEW' AS n, 'IN_REGION' AS t, 'FAR' AS r, NULL::INTEGER AS none",
    ),
    "update_create_rows": (
        "MATCH (c:Customer) WHERE c.c_acctbal > 9000 CREATE (s:Supplier {s_suppkey: c.c_custkey + 100000, s_name: c.c_name, s_nationkey: c.c_nationkey})-[:IN_NATION]->(n:Nation {n_nationkey: 1000 + c.c_custkey});; "
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) RETURN s.s_suppkey AS s, n.n_nationkey AS n, s.s_acctbal AS b",
        "SELECT s_suppkey AS s, s_nationkey AS n, s_acctbal AS b FROM supplier UNION ALL SELECT c_custkey + 100000, 1000 + c_custkey, NULL FROM customer WHERE c_acctbal > 9000",
    ),
}


def _path(g: GraphSession, kind: str) -> str:
    return f"{shared_dir(g.spark)}/{uuid.uuid4().hex}.{kind}"


def _round_trip(kind: str, headers: str = "") -> Callable[[GraphSession], DataFrame]:
    def run(g: GraphSession) -> DataFrame:
        """COPY TO, then LOAD FROM."""
        path = _path(g, kind)
        g.cypher(f"COPY (MATCH (s:Supplier) RETURN s.s_suppkey AS s_suppkey, s.s_name AS s_name, s.s_acctbal AS s_acctbal) TO '{path}'")
        start = f"LOAD WITH HEADERS ({headers}) FROM" if headers else "LOAD FROM"
        return g.cypher(f"{start} '{path}' WHERE s_acctbal > 0 RETURN s_suppkey AS k, upper(s_name) AS n, s_acctbal AS b")

    return run


def _copy_rel(g: GraphSession) -> DataFrame:
    """COPY of nodes and relationships into new tables."""
    nodes, rels = _path(g, "parquet"), _path(g, "csv")
    g.cypher("CREATE NODE TABLE N (n_nationkey INT64, n_name STRING, PRIMARY KEY (n_nationkey))")
    g.cypher("CREATE REL TABLE NEAR (FROM N TO N, km INT64)")
    g.cypher(f"COPY (MATCH (n:Nation) RETURN n.n_nationkey AS n_nationkey, n.n_name AS n_name) TO '{nodes}'")
    g.cypher(f"COPY N FROM '{nodes}'")
    g.cypher(f"COPY (MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey RETURN a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey * b.n_nationkey AS km) TO '{rels}'")
    g.cypher(f"COPY NEAR FROM '{rels}'")
    return g.cypher("MATCH (a:N)-[r:NEAR]->(b:N) RETURN a.n_name AS a, b.n_name AS b, r.km AS km")


def _atomic(g: GraphSession) -> DataFrame:
    """Statements that fail leave the graph as it was, as does a transaction rolled back."""
    for bad in ("MERGE (r:Region {r_regionkey: 77}) RETURN nosuch.x", "CREATE (r:Region {r_regionkey: 1})", "UNWIND [70, 70] AS k CREATE (r:Region {r_regionkey: k})", "CREATE (a:Region {r_regionkey: 71}), (b:Region {r_regionkey: 0})", "MATCH (r:Region) SET r.r_name = 'x', r.r_regionkey = 5"):
        try:
            g.cypher(bad)
        except Exception as e:  # noqa: BLE001 - each has to fail
            g.warnings.append(str(e))
    g.cypher("BEGIN TRANSACTION")
    g.cypher("MATCH (r:Region) SET r.r_name = 'gone'")
    g.cypher("ROLLBACK")
    return g.cypher(f"MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n, {len(g.warnings)} AS failed")


SUPPLIERS = "SELECT s_suppkey{cast} AS k, upper(s_name) AS n, s_acctbal AS b FROM supplier WHERE s_acctbal > 0"


def register(text: Callable[..., None], code: Callable[..., Callable]) -> None:
    for name, (query, sql) in QUERIES.items():
        text(name, query, sql)
    code("copy_to_csv_load_csv", SUPPLIERS.format(cast=""))(_round_trip("csv", "s_suppkey INT64, s_name STRING, s_acctbal DOUBLE"))
    code("copy_to_json_load_json", SUPPLIERS.format(cast=""))(_round_trip("json"))
    code("copy_to_parquet_load_parquet", SUPPLIERS.format(cast=""))(_round_trip("parquet"))
    code("copy_rel_from_csv", "SELECT a.n_name AS a, b.n_name AS b, (a.n_nationkey * b.n_nationkey)::BIGINT AS km FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(_copy_rel)
    code("update_atomic", "SELECT r_regionkey AS k, r_name AS n, 5 AS failed FROM region")(_atomic)
