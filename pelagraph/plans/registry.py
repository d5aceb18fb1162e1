"""Every registered query of the graph engine, and the SQL that states the same result.

A query is text of the dialect over the test graph, or a function of the graph session; its SQL runs on the
base tables. Order is not part of a result, except through LIMIT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagraph.operators import algorithms as alg
from pelagraph.operators import search, shard
from pelagraph.plans import function_queries, graph_queries, search_queries, session_queries, update_queries
from pelagraph.plans.testgraph import test_graph
from pelagraph.session import GraphSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def text(name: str, cypher: str, sql: str | None = None, **parameters) -> None:
    """A query of one statement, or of several of which the last gives the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = test_graph(spark, sf_dir)
        *before, last = [x for x in cypher.split(";;") if x.strip()]
        for x in before:
            g.cypher(x)
        return g.cypher(last, parameters)

    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def code(name: str, sql: str | None = None):
    def add(f: Callable[[GraphSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(test_graph(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def with_folder(name: str, f: Callable[[GraphSession, str], DataFrame], sql: str) -> None:
    """A query that reads the tables' folder as well."""
    QUERIES[name] = lambda spark, sf_dir: f(test_graph(spark, sf_dir), sf_dir)
    ORACLE[name] = sql


# ---------------------------------------------------------------- scans, projection, filters
text("flagship_segment_orders", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(*) AS n, sum(o.o_totalprice) AS total ORDER BY total DESC LIMIT 5",
     "SELECT c_mktsegment AS seg, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY total DESC LIMIT 5")
text("scan_node_inline_property", "MATCH (p:Part {p_brand: 'Brand#3'}) RETURN p.p_partkey AS k, p.p_name AS n", "SELECT p_partkey AS k, p_name AS n FROM part WHERE p_brand = 'Brand#3'")
text("scan_node_all_properties", "MATCH (n:Nation) RETURN n.*", "SELECT * FROM nation")
text("scan_multi_label", "MATCH (a:Customer|Supplier) RETURN label(a) AS l, count(*) AS n", "SELECT 'Customer' AS l, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier")
text("scan_index_equality", "MATCH (o:Order) WHERE o.o_orderkey = 77 RETURN o.o_totalprice AS p", "SELECT o_totalprice AS p FROM orders WHERE o_orderkey = 77")
text("scan_index_in_list", "MATCH (o:Order) WHERE o.o_orderkey IN [1, 2, 3, 500] RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (1, 2, 3, 500)")
text("scan_index_or", "MATCH (c:Customer) WHERE c.c_custkey = 5 OR c.c_custkey = 9 RETURN c.c_name AS n", "SELECT c_name AS n FROM customer WHERE c_custkey IN (5, 9)")
text("scan_index_prefix", "MATCH (p:Part) WHERE p.p_name STARTS WITH 'blue' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_name LIKE 'blue%'")
text("expressions_scan", "RETURN 1 + 1 AS two, 7 / 2 AS whole, 7.0 / 2 AS half, 2 ^ 3 AS p, 7 % 4 AS m, 'a' || 'b' AS t", "SELECT 2::BIGINT AS two, 3::BIGINT AS whole, 3.5::DOUBLE AS half, 8.0::DOUBLE AS p, 3::BIGINT AS m, 'ab' AS t")
text("unwind_list", "UNWIND [1, 2, 3] AS x UNWIND ['a', 'b'] AS y RETURN x, y", "SELECT x, y FROM (VALUES (1), (2), (3)) a(x), (VALUES ('a'), ('b')) b(y)")
text("unwind_after_match", "MATCH (r:Region) UNWIND range(1, 2) AS i RETURN r.r_name AS n, i", "SELECT r_name AS n, i FROM region, range(1, 3) t(i)")
text("filter_comparisons", "MATCH (c:Customer) WHERE c.c_acctbal >= 1000 AND c.c_acctbal < 5000 AND c.c_mktsegment <> 'BUILDING' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000 AND c_mktsegment <> 'BUILDING'")
text("filter_boolean", "MATCH (p:Part) WHERE (p.p_size > 40 XOR p.p_retailprice > 1500) OR NOT (p.p_brand CONTAINS '#') RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE ((p_size > 40) <> (p_retailprice > 1500)) OR NOT contains(p_brand, '#')")
text("filter_text", "MATCH (p:Part) WHERE p.p_name ENDS WITH 'ring' OR p.p_name CONTAINS 'green' RETURN p.p_partkey AS k, p.p_name AS n", "SELECT p_partkey AS k, p_name AS n FROM part WHERE ends_with(p_name, 'ring') OR contains(p_name, 'green')")
text("filter_null_lowest", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE s.s_acctbal > 5000 WITH n, s WHERE s.s_acctbal < 7000 RETURN n.n_name AS n, s.s_acctbal AS b", "SELECT n_name AS n, s_acctbal AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 WHERE s_acctbal IS NULL OR s_acctbal < 7000")
text("filter_is_null", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE s.s_acctbal > 5000 WITH n, s WHERE s IS NULL RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
text("case_searched_and_simple", "MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'mid' ELSE 'big' END AS c, CASE p.p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END AS b", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS c, CASE p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END AS b FROM part")
text("cast_values", "MATCH (p:Part) RETURN p.p_partkey AS k, CAST(p.p_retailprice AS INT64) AS i, CAST(p.p_size AS STRING) AS s, CAST(p.p_name AS INT64) AS bad", "SELECT p_partkey AS k, trunc(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, try_cast(p_name AS BIGINT) AS bad FROM part")
text("parameters", "MATCH (c:Customer) WHERE c.c_mktsegment = $seg AND c.c_acctbal > $low RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 2000", seg="MACHINERY", low=2000)
text("quantifiers", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, p.p_size + 10, 25] AS l RETURN k, ALL(x IN l WHERE x > 20) AS a, ANY(x IN l WHERE x > 50) AS b, NONE(x IN l WHERE x = 25) AS c, SINGLE(x IN l WHERE x >= 25) AS d",
     "SELECT p_partkey AS k, p_size > 20 AND p_size + 10 > 20 AS a, p_size > 50 OR p_size + 10 > 50 AS b, false AS c, ((p_size >= 25)::INT + (p_size + 10 >= 25)::INT + 1) = 1 AS d FROM part")
text("lambdas", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 3, 8] AS l RETURN k, list_filter(l, x -> x > 5) AS f, list_transform(l, x -> x * 2) AS t, list_reduce(l, (a, x) -> a + x) AS r, [x IN l WHERE x > 5 | x + 1] AS c",
     "SELECT p_partkey AS k, list_filter([p_size, 3, 8], lambda x: x > 5) AS f, [p_size * 2, 6, 16] AS t, p_size + 11 AS r, list_transform(list_filter([p_size, 3, 8], lambda x: x > 5), lambda x: x + 1) AS c FROM part")
text("literals_nested", "MATCH (r:Region) RETURN {name: r.r_name, size: 2}.name AS n, [1, 2, 3][2] AS second, [1, 2, 3, 4][2..3] AS mid", "SELECT r_name AS n, 2 AS second, [2, 3] AS mid FROM region")

# ---------------------------------------------------------------- subqueries
text("exists_subquery", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
text("exists_correlated_property", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice < c.c_acctbal * 2 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 2)")
text("not_exists_pattern", "MATCH (p:Part) WHERE NOT (p)<-[:HAS_PART]-(:Order) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
text("exists_in_projection", "MATCH (c:Customer) RETURN c.c_custkey AS k, EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderpriority STARTS WITH '1' } AS urgent", "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS urgent FROM customer")
text("exists_or_condition", "MATCH (c:Customer) WHERE c.c_acctbal < 0 OR EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
text("count_subquery", "MATCH (c:Customer) RETURN c.c_custkey AS k, COUNT { MATCH (c)-[:PLACED]->(o:Order) } AS n", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
text("call_uncorrelated", "MATCH (r:Region) CALL { MATCH (n:Nation) RETURN count(*) AS total } RETURN r.r_name AS r, total", "SELECT r_name AS r, (SELECT count(*) FROM nation) AS total FROM region")
text("call_correlated", "MATCH (n:Nation) CALL { WITH n MATCH (c:Customer)-[:IN_NATION]->(n) RETURN count(*) AS customers, max(c.c_acctbal) AS best } RETURN n.n_name AS n, customers, best", "SELECT n_name AS n, count(c_custkey) AS customers, max(c_acctbal) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")

# ---------------------------------------------------------------- patterns and joins
text("expand_out", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
text("expand_in", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WHERE r.r_name = 'ASIA' RETURN n.n_name AS n", "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
text("expand_undirected", "MATCH (a:Part)-[:CO_ORDERED]-(b:Part) RETURN a.p_partkey AS k, count(*) AS n, sum(b.p_size) AS s", "WITH s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM s a JOIN s b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) SELECT x AS k, count(*) AS n, sum(p_size)::DOUBLE AS s FROM u JOIN part ON p_partkey = y GROUP BY 1")
text("expand_multi_type", "MATCH (o:Order)-[r:HAS_PART|SOLD_BY]->(x) RETURN type(r) AS t, count(*) AS n", "SELECT 'HAS_PART' AS t, count(*) AS n FROM lineitem UNION ALL SELECT 'SOLD_BY', count(*) FROM lineitem")
text("expand_multi_pair", "MATCH (a)-[:IN_NATION]->(n:Nation) RETURN label(a) AS l, n.n_name AS n, count(*) AS c", "SELECT 'Customer' AS l, n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'Supplier', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2")
text("expand_edge_properties", "MATCH (o:Order)-[h:HAS_PART {l_returnflag: 'R'}]->(p:Part) WHERE h.l_quantity > 48 RETURN p.p_brand AS b, count(*) AS n, sum(h.l_extendedprice * (1 - h.l_discount)) AS revenue", "SELECT p_brand AS b, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1")
text("expand_chain", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS r, count(o) AS orders, avg(o.o_totalprice) AS mean", "SELECT r_name AS r, count(*) AS orders, avg(o_totalprice) AS mean FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
text("join_shared_variable", "MATCH (o:Order)-[:HAS_PART]->(p:Part), (o)-[:SOLD_BY]->(s:Supplier) WHERE p.p_size = 10 RETURN s.s_name AS s, count(*) AS n", "SELECT s_name AS s, count(*) AS n FROM lineitem a JOIN part ON a.l_partkey = p_partkey JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN supplier ON b.l_suppkey = s_suppkey WHERE p_size = 10 GROUP BY 1")
text("join_same_nation", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE c.c_acctbal > 9000 RETURN n.n_name AS n, count(*) AS pairs", "SELECT n_name AS n, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1")
text("cyclic_pattern", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:SOLD_BY]->(s:Supplier)-[:IN_NATION]->(n:Nation), (c)-[:IN_NATION]->(n) RETURN n.n_name AS n, count(*) AS local", "SELECT n_name AS n, count(*) AS local FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey GROUP BY 1")
text("cross_product", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
text("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, o.o_orderkey AS o", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
text("optional_chain_count", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.n_name AS n, count(o) AS orders", "SELECT n_name AS n, count(o_orderkey) AS orders FROM nation LEFT JOIN (customer JOIN orders ON o_custkey = c_custkey) ON c_nationkey = n_nationkey GROUP BY 1")
_EDGES = "WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM s a JOIN s b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey)"
text("recursive_bounded", "MATCH (a:Part {p_partkey: 1})-[:CO_ORDERED*1..3]->(b:Part) RETURN b.p_partkey AS k, count(*) AS paths", f"{_EDGES}, w AS (SELECT y, 1 AS d FROM e WHERE x = 1 UNION ALL SELECT e.y, d + 1 FROM w JOIN e ON w.y = e.x WHERE d < 3) SELECT y AS k, count(*) AS paths FROM w GROUP BY 1")
text("recursive_per_hop", "MATCH (a:Part {p_partkey: 2})-[:CO_ORDERED*1..2 (r, n | WHERE n.p_size > 25)]->(b:Part) RETURN b.p_partkey AS k, count(*) AS paths", f"{_EDGES}, f AS (SELECT x, y FROM e JOIN part ON p_partkey = y WHERE p_size > 25), w AS (SELECT y, 1 AS d FROM f WHERE x = 2 UNION ALL SELECT f.y, d + 1 FROM w JOIN f ON w.y = f.x WHERE d < 2) SELECT y AS k, count(*) AS paths FROM w GROUP BY 1")
text("recursive_zero_hops", "MATCH (a:Part)-[r:CO_ORDERED*0..1]->(b:Part) RETURN length(r) AS hops, count(*) AS n, sum(b.p_size) AS s", f"{_EDGES} SELECT 0::BIGINT AS hops, count(*) AS n, sum(p_size)::DOUBLE AS s FROM part UNION ALL SELECT 1, count(*), sum(p_size) FROM e JOIN part ON p_partkey = y")
text("path_value", "MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN length(p) AS l, nodes(p)[1] AS a, nodes(p)[2] AS b, size(rels(p)) AS r, is_acyclic(p) AS acyclic", "SELECT 1::BIGINT AS l, n_nationkey::VARCHAR AS a, n_regionkey::VARCHAR AS b, 1::BIGINT AS r, n_nationkey <> n_regionkey AS acyclic FROM nation")
text("path_recursive", "MATCH p = (a:Part {p_partkey: 50})-[:CO_ORDERED*1..2]->(b:Part) RETURN b.p_partkey AS k, length(p) AS l, is_trail(p) AS t", f"{_EDGES}, w AS (SELECT y, 1 AS d FROM e WHERE x = 50 UNION ALL SELECT e.y, d + 1 FROM w JOIN e ON w.y = e.x WHERE d < 2) SELECT y AS k, d::BIGINT AS l, true AS t FROM w")

# ---------------------------------------------------------------- aggregation
text("aggregate_all_functions", "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n, count(DISTINCT o.o_custkey) AS customers, sum(o.o_totalprice) AS total, avg(o.o_totalprice) AS mean, min(o.o_totalprice) AS low, max(o.o_totalprice) AS high, count_if(o.o_totalprice > 200000) AS big", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) FILTER (o_totalprice > 200000) AS big FROM orders GROUP BY 1")
text("aggregate_global", "MATCH (p:Part) WHERE p.p_size > 1000 RETURN count(*) AS n, sum(p.p_size) AS s, collect(p.p_size) AS l", "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s, []::INTEGER[] AS l")
text("aggregate_nested_expression", "MATCH (o:Order) RETURN o.o_orderpriority AS p, count(*) + 1 AS n, sum(o.o_totalprice) / count(*) AS mean", "SELECT o_orderpriority AS p, count(*) + 1 AS n, sum(o_totalprice) / count(*) AS mean FROM orders GROUP BY 1")
text("aggregate_distinct", "MATCH (p:Part) RETURN p.p_brand AS b, sum(DISTINCT p.p_size) AS s, avg(DISTINCT p.p_size) AS a, list_sort(collect(DISTINCT p.p_size)) AS l", "SELECT p_brand AS b, sum(DISTINCT p_size)::DOUBLE AS s, avg(DISTINCT p_size) AS a, list_sort(list(DISTINCT p_size)) AS l FROM part GROUP BY 1")
text("aggregate_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n, sum(o.o_totalprice) AS total WHERE n > 15 RETURN c.c_custkey AS k, n, total", "SELECT c_custkey AS k, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 15")
text("aggregate_of_aggregate", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_custkey AS k, count(*) AS n RETURN n, count(*) AS customers", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
text("aggregate_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, list_sort(collect(n.n_name)) AS nations", "SELECT r_name AS r, list_sort(list(n_name)) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
text("distinct_rows", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS b, p.p_size % 2 AS odd", "SELECT DISTINCT p_brand AS b, p_size % 2 AS odd FROM part")
text("lineitem_summary", "MATCH (o:Order)-[h:HAS_PART]->(p:Part) WHERE h.l_shipdate <= timestamp('1998-09-02') RETURN h.l_returnflag AS f, h.l_linestatus AS s, sum(h.l_quantity) AS qty, sum(h.l_extendedprice * (1 - h.l_discount) * (1 + h.l_tax)) AS charge, avg(h.l_discount) AS disc, count(*) AS n", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS qty, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge, avg(l_discount) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")

# ---------------------------------------------------------------- windows
_W = "MATCH (c:Customer) RETURN c.c_custkey AS k, "
for _n, _c, _s in (
    ("row_number", "row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_acctbal DESC, c.c_custkey) AS v", "row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS v"),
    ("rank", "rank() OVER (ORDER BY c.c_nationkey) AS v", "rank() OVER (ORDER BY c_nationkey) AS v"),
    ("dense_rank", "dense_rank() OVER (ORDER BY c.c_nationkey) AS v", "dense_rank() OVER (ORDER BY c_nationkey) AS v"),
    ("percent_rank", "percent_rank() OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_nationkey) AS v", "percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS v"),
    ("cume_dist", "cume_dist() OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_nationkey) AS v", "cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS v"),
    ("ntile", "ntile(4) OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_custkey) AS v", "floor((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_mktsegment))::BIGINT + 1 AS v"),
    ("lag", "lag(c.c_acctbal, 1) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS v", "lag(c_acctbal, 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v"),
    ("lead_default", "lead(c.c_custkey, 2, -1) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS v", "lead(c_custkey, 2, -1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v"),
    ("first_value", "first_value(c.c_acctbal) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS v", "first_value(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v"),
    ("last_value_frame", "last_value(c.c_custkey) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v", "last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v"),
    ("nth_value", "nth_value(c.c_custkey, 2) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS v", "nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v"),
    ("sum_running", "sum(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_custkey) AS v", "sum(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS v"),
    ("avg_rows_frame", "avg(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v", "avg(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v"),
    ("count_frame", "count(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_custkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v", "count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v"),
    ("min_max_range", "max(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - min(c.c_acctbal) OVER (PARTITION BY c.c_mktsegment) AS v", "max(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - min(c_acctbal) OVER (PARTITION BY c_mktsegment) AS v"),
    ("groups_frame", "sum(c.c_custkey) OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_custkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v", "sum(c_custkey::DOUBLE) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v"),
):
    text(f"window_{_n}", _W + _c, f"SELECT c_custkey AS k, {_s} FROM customer")
text("window_ordered_result", "MATCH (c:Customer) RETURN c.c_custkey AS k, rank() OVER (ORDER BY c.c_acctbal DESC) AS r ORDER BY r, k LIMIT 7", "SELECT c_custkey AS k, rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer ORDER BY r, k LIMIT 7")

# ---------------------------------------------------------------- order, limit, set operations
text("top_k", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10")
text("order_skip_limit", "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_acctbal, k SKIP 5 LIMIT 10", "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5")
text("order_by_aggregate", "MATCH (c:Customer) RETURN c.c_nationkey AS n, count(*) AS c ORDER BY count(*) DESC, n LIMIT 4", "SELECT c_nationkey AS n, count(*) AS c FROM customer GROUP BY 1 ORDER BY c DESC, n LIMIT 4")
text("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text("union_all", "MATCH (r:Region) RETURN r.r_name AS n UNION ALL MATCH (n:Nation) RETURN n.n_name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation")
text("with_pipeline", "MATCH (p:Part) WITH p ORDER BY p.p_retailprice DESC, p.p_partkey LIMIT 5 MATCH (o:Order)-[:HAS_PART]->(p) RETURN p.p_partkey AS k, count(*) AS n", "SELECT p_partkey AS k, count(*) AS n FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")

# ---------------------------------------------------------------- scalar functions
text("functions_numbers", "MATCH (p:Part) WITH p.p_partkey AS k, p.p_retailprice AS x, p.p_size AS n RETURN k, abs(-x) AS a, ceil(x) AS c, floor(x) AS f, round(x / 7, 2) AS r, sign(n - 25) AS s, sqrt(x) AS q, log(x) AS l10, ln(x) AS l, n % 7 AS m, gcd(n, 12) AS g, lcm(n, 6) AS lc, factorial(n % 10) AS fa, bitwise_and(n, 6) AS ba, bitshift_left(n, 2) AS sh, hypot(n, 3) AS h, even(n) AS ev, degrees(1.0) AS d",
     "SELECT p_partkey AS k, abs(-p_retailprice) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round_even(p_retailprice / 7, 2) AS r, sign(p_size - 25)::BIGINT AS s, sqrt(p_retailprice) AS q, log10(p_retailprice) AS l10, ln(p_retailprice) AS l, p_size % 7 AS m, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 6)::BIGINT AS lc, factorial(p_size % 10)::BIGINT AS fa, p_size & 6 AS ba, (p_size * 4)::BIGINT AS sh, sqrt(p_size * p_size + 9.0) AS h, 2 * floor(p_size / 2.0)::BIGINT AS ev, degrees(1.0) AS d FROM part")
text("functions_texts", "MATCH (p:Part) WITH p.p_partkey AS k, p.p_name AS s RETURN k, upper(s) AS u, substring(s, 1, 3) AS sub, left(s, 2) AS l, right(s, 2) AS r, reverse(s) AS rev, replace(s, 'e', 'E') AS rep, lpad(s, 12, '*') AS lp, position(s, 'e') AS pos, split_part(s, ' ', 2) AS sp, size(s) AS n, concat(s, '!') AS c, repeat(left(s, 1), 3) AS rp, regexp_replace(s, '[aeiou]', '') AS rr, regexp_matches(s, '^b') AS rm, levenshtein(s, 'blue ring') AS lev, md5(s) AS h, ascii(s) AS a, initcap(s) AS ic, trim('  x ') AS t",
     "SELECT p_partkey AS k, upper(p_name) AS u, substr(p_name, 2, 3) AS sub, left(p_name, 2) AS l, right(p_name, 2) AS r, reverse(p_name) AS rev, replace(p_name, 'e', 'E') AS rep, lpad(p_name, 12, '*') AS lp, strpos(p_name, 'e')::BIGINT AS pos, split_part(p_name, ' ', 2) AS sp, length(p_name) AS n, p_name || '!' AS c, repeat(left(p_name, 1), 3) AS rp, regexp_replace(p_name, '[aeiou]', '', 'g') AS rr, regexp_matches(p_name, '^b') AS rm, levenshtein(p_name, 'blue ring') AS lev, md5(p_name) AS h, ascii(p_name)::BIGINT AS a, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ic, 'x' AS t FROM part")
text("functions_dates", "MATCH (o:Order) WITH o.o_orderkey AS k, o.o_orderdate AS d RETURN k, year(d) AS y, month(d) AS m, day(d) AS dd, quarter(d) AS q, week(d) AS w, dayofweek(d) AS dow, dayofyear(d) AS doy, date_trunc('month', d) AS tr, date_add('day', d, 10) AS a, date_sub('month', d, 1) AS s, date_diff('day', d, timestamp('1998-12-31')) AS df, epoch(d) AS e, dayname(d) AS dn, monthname(d) AS mn, last_day(d) AS ld, century(d) AS c",
     "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, week(o_orderdate) AS w, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, date_trunc('month', o_orderdate)::TIMESTAMP AS tr, o_orderdate + INTERVAL 10 DAY AS a, o_orderdate - INTERVAL 1 MONTH AS s, ((epoch_us(TIMESTAMP '1998-12-31') - epoch_us(o_orderdate)) // 86400000000)::BIGINT AS df, epoch(o_orderdate)::BIGINT AS e, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, last_day(o_orderdate) AS ld, century(o_orderdate) AS c FROM orders")
text("functions_intervals", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_orderdate + interval('1 month 3 days') AS a, o.o_orderdate - to_hours(5) AS b, month(interval('14 months')) AS m", "SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 5 HOUR AS b, 2::BIGINT AS m FROM orders")
text("functions_casts", "MATCH (p:Part) RETURN p.p_partkey AS k, to_int64(p.p_retailprice) AS i, to_string(p.p_size) AS s, to_double(p.p_size) AS d, to_bool(p.p_size - 1) AS b, to_int64('12x') AS bad, typeof(p.p_retailprice) AS t", "SELECT p_partkey AS k, trunc(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, p_size::DOUBLE AS d, p_size <> 1 AS b, NULL::BIGINT AS bad, 'DOUBLE' AS t FROM part")
text("functions_lists", "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 5, 9, 5] AS l RETURN k, list_len(l) AS n, list_contains(l, 9) AS c, list_position(l, 5) AS p, list_sort(l) AS s, list_reverse(l) AS r, list_distinct(l) AS d, list_sum(l) AS t, list_min(l) AS lo, list_max(l) AS hi, list_slice(l, 2, 3) AS sl, list_append(l, 1) AS a, list_remove(l, 5) AS rm, list_except(l, [5]) AS e, list_to_string(l, '-') AS js, list_avg(l) AS av",
     "SELECT p_partkey AS k, 4::BIGINT AS n, true AS c, CASE WHEN p_size = 5 THEN 1 ELSE 2 END::BIGINT AS p, list_sort([p_size, 5, 9, 5]) AS s, [5, 9, 5, p_size] AS r, CASE WHEN p_size = 5 THEN [5, 9] WHEN p_size = 9 THEN [9, 5] ELSE [p_size, 5, 9] END AS d, (p_size + 19)::DOUBLE AS t, least(p_size, 5)::DOUBLE AS lo, greatest(p_size, 9)::DOUBLE AS hi, [5, 9] AS sl, [p_size, 5, 9, 5, 1] AS a, CASE WHEN p_size = 5 THEN [5, 9, 5] ELSE [p_size, 9, 5] END AS rm, CASE WHEN p_size = 5 THEN [9] ELSE [p_size, 9] END AS e, concat_ws('-', p_size, 5, 9, 5) AS js, (p_size + 19) / 4.0::DOUBLE AS av FROM part")
text("functions_maps_structs", "MATCH (p:Part) WITH p.p_partkey AS k, map(['a', 'b'], [p.p_size, 2]) AS m, struct_pack('x', p.p_size, 'y', p.p_brand) AS s RETURN k, map_keys(m) AS ks, map_extract(m, 'a') AS v, map_size(m) AS n, map_contains(m, 'z') AS c, struct_extract(s, 'y') AS y, keys(s) AS f, union_tag(union_value(1, 'num')) AS t",
     "SELECT p_partkey AS k, ['a', 'b'] AS ks, [p_size] AS v, 2::BIGINT AS n, false AS c, p_brand AS y, ['x', 'y'] AS f, 'num' AS t FROM part")
text("functions_hashes", "MATCH (p:Part) RETURN p.p_partkey AS k, md5(p.p_brand) AS m, sha256(p.p_brand) AS s, base64_encode(p.p_brand) AS b, to_hex(p.p_size) AS h, bit_length(p.p_brand) AS bl", "SELECT p_partkey AS k, md5(p_brand) AS m, sha256(p_brand) AS s, base64(p_brand::BLOB) AS b, lower(to_hex(p_size)) AS h, bit_length(p_brand)::BIGINT AS bl FROM part")
text("functions_conditionals", "MATCH (p:Part) RETURN p.p_partkey AS k, coalesce(null, p.p_size) AS c, nullif(p.p_size, 5) AS nf, greatest(p.p_size, 10) AS g, least(p.p_size, 10) AS l, if(p.p_size > 20, 'y', 'n') AS b, equal_null(null, null) AS e, bool_xor(true, p.p_size > 20) AS x", "SELECT p_partkey AS k, p_size AS c, nullif(p_size, 5) AS nf, greatest(p_size, 10) AS g, least(p_size, 10) AS l, CASE WHEN p_size > 20 THEN 'y' ELSE 'n' END AS b, true AS e, NOT (p_size > 20) AS x FROM part")
text("functions_ids", "MATCH (n:Nation)-[r:IN_REGION]->(m:Region) RETURN id(n) AS i, label(n) AS l, type(r) AS t, start_node(r) AS s, end_node(r) AS e, offset(id(n)) AS o", "SELECT 'Nation:' || n_nationkey AS i, 'Nation' AS l, 'IN_REGION' AS t, n_nationkey::VARCHAR AS s, n_regionkey::VARCHAR AS e, n_nationkey::VARCHAR AS o FROM nation")
text("functions_json", "MATCH (e:Event) RETURN e.event_id AS id, json_extract(e.props, '$.k') AS v, json_valid(e.props) AS ok, json_type(e.props) AS t, json_keys(e.props) AS ks", "SELECT event_id AS id, regexp_extract(props, ':\\s*(-?[0-9]+)', 1) AS v, true AS ok, 'OBJECT' AS t, ['k'] AS ks FROM events")
text("functions_json_build", "MATCH (r:Region) RETURN json_object('k', r.r_regionkey, 'n', r.r_name) AS o, json_array(1, 'x', true) AS a, json_merge_patch('{\"a\":1,\"b\":2}', '{\"b\":null,\"c\":3}') AS m, json_contains('{\"a\":[1,2]}', '{\"a\":[2]}') AS c, json_structure('{\"a\":1.5,\"b\":\"x\"}') AS s", """SELECT '{"k":' || r_regionkey || ',"n":"' || r_name || '"}' AS o, '[1,"x",true]' AS a, '{"a":1,"c":3}' AS m, true AS c, '{"a":"DOUBLE","b":"VARCHAR"}' AS s FROM region""")

# ---------------------------------------------------------------- updates, definitions, macros, files
text("update_create", "CREATE (r:Region {r_regionkey: 9, r_name: 'OCEANIA'});; MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n", "SELECT r_regionkey::INT AS k, r_name AS n FROM region UNION ALL SELECT 9, 'OCEANIA'")
text("update_create_rel", "MATCH (n:Nation {n_nationkey: 1}), (r:Region {r_regionkey: 0}) CREATE (n)-[:IN_REGION]->(r);; MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE n.n_nationkey = 1 RETURN r.r_regionkey AS k", "SELECT n_regionkey AS k FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 0")
text("update_set", "MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 0.0;; MATCH (c:Customer) RETURN c.c_mktsegment AS s, sum(c.c_acctbal) AS t, count(*) AS n", "SELECT c_mktsegment AS s, sum(greatest(c_acctbal, 0.0)) AS t, count(*) AS n FROM customer GROUP BY 1")
text("update_delete", "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 DELETE r;; MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE NOT o_totalprice > 100000")
text("update_detach_delete", "MATCH (n:Nation {n_nationkey: 3}) DETACH DELETE n;; MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_nationkey <> 3")
text("update_merge", "UNWIND [1, 2, 77] AS k MERGE (r:Region {r_regionkey: k}) ON CREATE SET r.r_name = 'NEW' ON MATCH SET r.r_name = 'OLD';; MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS n", "SELECT r_regionkey::INT AS k, CASE WHEN r_regionkey IN (1, 2) THEN 'OLD' ELSE r_name END AS n FROM region UNION ALL SELECT 77, 'NEW'")
text("define_tables", "CREATE NODE TABLE City(id INT64, name STRING, PRIMARY KEY(id));; CREATE REL TABLE NEXT(FROM City TO City, km INT64);; UNWIND [1, 2, 3] AS i CREATE (c:City {id: i, name: 'c' + i});; MATCH (a:City), (b:City) WHERE b.id = a.id + 1 CREATE (a)-[:NEXT {km: 10}]->(b);; ALTER TABLE City ADD size INT64 DEFAULT 7;; MATCH (a:City)-[n:NEXT]->(b:City) RETURN a.name AS a, b.name AS b, n.km AS km, b.size AS s", "SELECT * FROM (VALUES ('c1', 'c2', 10::BIGINT, 7::BIGINT), ('c2', 'c3', 10::BIGINT, 7::BIGINT)) t(a, b, km, s)")
text("macro_call", "CREATE MACRO net(price, off := 0.1) AS price * (1 - off);; MATCH (p:Part) RETURN p.p_partkey AS k, net(p.p_retailprice) AS a, net(p.p_retailprice, 0.5) AS b", "SELECT p_partkey AS k, p_retailprice * (1 - 0.1) AS a, p_retailprice * (1 - 0.5) AS b FROM part")


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphSession(spark).cypher(f"LOAD FROM '{sf_dir}/nation.parquet' WHERE n_regionkey = 2 RETURN n_name AS n, n_nationkey + 1 AS k")


QUERIES["load_from_parquet"] = _load
ORACLE["load_from_parquet"] = "SELECT n_name AS n, n_nationkey + 1 AS k FROM nation WHERE n_regionkey = 2"


def _copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.cypher("CREATE NODE TABLE N(n_nationkey INT64, n_name STRING, n_regionkey INT64, PRIMARY KEY(n_nationkey))")
    g.cypher(f"COPY N FROM '{sf_dir}/nation.parquet'")
    return g.cypher("MATCH (n:N) WHERE n.n_regionkey <> 1 RETURN n.n_nationkey AS k, n.n_name AS n")


QUERIES["copy_from_parquet"] = _copy
ORACLE["copy_from_parquet"] = "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE n_regionkey <> 1"
text("call_show_tables", "CALL show_tables() YIELD name, type AS kind WHERE kind = 'REL' RETURN name AS n", "SELECT * FROM (VALUES ('CO_ORDERED'), ('DID'), ('HAS_PART'), ('IN_NATION'), ('IN_REGION'), ('PLACED'), ('SOLD_BY')) t(n)")

function_queries.register(text)
update_queries.register(text, code)
search_queries.register(text, code)
session_queries.register(with_folder)

# ---------------------------------------------------------------- algorithms
_BOTH = f"{_EDGES}, u AS (SELECT x, y FROM e UNION SELECT y, x FROM e)"
text("algo_sssp", "CALL sssp('CO_ORDERED', 1) YIELD node, distance RETURN node, distance", f"{_EDGES}, w AS (SELECT 1::BIGINT AS node, 0 AS d UNION SELECT e.y, d + 1 FROM w JOIN e ON w.node = e.x WHERE d < 12) SELECT p_partkey AS node, min(d)::DOUBLE AS distance FROM part LEFT JOIN w ON w.node = p_partkey GROUP BY 1")
text("algo_sssp_both", "CALL sssp('CO_ORDERED', 5, 'BOTH') YIELD node, distance WHERE distance IS NOT NULL AND distance < 3 RETURN node, distance", f"{_BOTH}, w AS (SELECT 5::BIGINT AS node, 0 AS d UNION SELECT u.y, d + 1 FROM w JOIN u ON w.node = u.x WHERE d < 2) SELECT node, min(d)::DOUBLE AS distance FROM w GROUP BY 1")
text("algo_k_hop", "CALL k_hop('CO_ORDERED', 2, 2) YIELD node, hops RETURN node, hops", f"{_EDGES}, w AS (SELECT 2::BIGINT AS node, 0 AS d UNION SELECT e.y, d + 1 FROM w JOIN e ON w.node = e.x WHERE d < 2) SELECT node, min(d)::BIGINT AS hops FROM w GROUP BY 1 HAVING min(d) > 0")
text("algo_paths", "CALL variable_length_path('CO_ORDERED', 55, 2) YIELD target, length, path RETURN target, length, path", f"{_EDGES}, w AS (SELECT y, [55, y] AS p FROM e WHERE x = 55 UNION ALL SELECT e.y, list_append(p, e.y) FROM w JOIN e ON w.y = e.x WHERE len(p) < 3) SELECT y AS target, len(p) - 1 AS length, p AS path FROM w")
text("algo_degree", "CALL node_degree('CO_ORDERED', 'BOTH') YIELD node, degree RETURN node, degree", f"{_EDGES}, d AS (SELECT x AS k FROM e UNION ALL SELECT y FROM e) SELECT p_partkey AS node, count(k) AS degree FROM part LEFT JOIN d ON k = p_partkey GROUP BY 1")
text("algo_density", "CALL graph_density('CO_ORDERED') YIELD vertices, edges, density RETURN vertices, edges, density", f"{_EDGES}, n AS (SELECT count(*) AS v FROM part), m AS (SELECT count(*) AS c FROM e) SELECT v AS vertices, c AS edges, c / (v * (v - 1)) AS density FROM n, m")
text("algo_pagerank_two_rounds", "CALL pagerank('CO_ORDERED', 2, 0.85) YIELD node, rank RETURN node, rank", f"""{_EDGES}, deg AS (SELECT x, count(*) AS d FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM part),
r0 AS (SELECT p_partkey AS id, 1.0 / n AS r FROM part, n),
g1 AS (SELECT e.y AS id, sum(r / d) AS s FROM r0 JOIN e ON r0.id = e.x JOIN deg ON deg.x = e.x GROUP BY 1), k1 AS (SELECT sum(r) AS s FROM r0 WHERE id NOT IN (SELECT x FROM deg)),
r1 AS (SELECT r0.id, 0.15 / n + 0.85 * (coalesce(g1.s, 0) + k1.s / n) AS r FROM r0 LEFT JOIN g1 ON r0.id = g1.id, n, k1),
g2 AS (SELECT e.y AS id, sum(r / d) AS s FROM r1 JOIN e ON r1.id = e.x JOIN deg ON deg.x = e.x GROUP BY 1), k2 AS (SELECT sum(r) AS s FROM r1 WHERE id NOT IN (SELECT x FROM deg))
SELECT r1.id AS node, 0.15 / n + 0.85 * (coalesce(g2.s, 0) + k2.s / n) AS rank FROM r1 LEFT JOIN g2 ON r1.id = g2.id, n, k2""")
graph_queries.register(text, code, _EDGES)
text("algo_sssp_paths", "CALL sssp_paths('CO_ORDERED', 40) YIELD node, distance, length RETURN node, distance, length", f"{_EDGES}, w AS (SELECT 40::BIGINT AS node, 0 AS d UNION SELECT e.y, d + 1 FROM w JOIN e ON w.node = e.x WHERE d < 12) SELECT node, min(d)::DOUBLE AS distance, min(d)::BIGINT AS length FROM w GROUP BY 1")


@code("algo_scc", """WITH RECURSIVE t AS (SELECT c_nationkey AS x, s_nationkey AS y, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS (SELECT x, y FROM t WHERE n > (SELECT 1.4 * avg(n) FROM t)), r AS (SELECT n_nationkey AS x, n_nationkey AS y FROM nation UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT a.x AS id, min(a.y) AS component_id FROM r a JOIN r b ON a.x = b.y AND a.y = b.x GROUP BY 1""")
def _trade(g: GraphSession) -> DataFrame:
    """Nations, with an edge to each nation from which they buy more than 1.4 times the usual number of items."""
    t = g.cypher("MATCH (a:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:SOLD_BY]->(s:Supplier)-[:IN_NATION]->(b:Nation) RETURN a.n_nationkey AS src, b.n_nationkey AS dst, count(*) AS n")
    much = t.crossJoin(t.agg((F.avg("n") * 1.4).alias("least"))).where("n > least")  # one row
    return alg.scc(alg.Graph.of(g.catalog.node("Nation").df.select(F.col("n_nationkey").alias("id")), much))


# ---------------------------------------------------------------- search
@code("fts_bm25", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
k AS (SELECT * FROM t WHERE w NOT IN ({", ".join(f"'{w}'" for w in search.STOP_WORDS)})),
len AS (SELECT d.doc_id, count(w) AS n FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY 1), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
tf AS (SELECT doc_id, w, count(*) AS tf FROM k WHERE w IN ('license', 'idiot', 'version') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id AS node, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score
FROM tf JOIN df USING (w) JOIN len USING (doc_id), s GROUP BY 1 ORDER BY score DESC, node LIMIT 20""")
def _bm25(g: GraphSession) -> DataFrame:
    g.cypher("CALL create_fts_index('Document', 'docs', ['text'], false) RETURN result")
    return g.cypher("CALL query_fts_index('docs', 'license idiot version', 20) YIELD node, score RETURN node, round(score, 9) AS score")


@code("vector_query", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id AS id, round(d, 9) AS distance FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) AS d FROM embeddings, q) ORDER BY d, vec_id LIMIT 10")
def _vector(g: GraphSession) -> DataFrame:
    v = g.catalog.node("Vector").df.where("vec_id = 7").first()["embedding"]
    g.cypher("CALL create_vector_index('Vector', 'vecs', 'embedding', 'cosine') RETURN result")
    return g.cypher("CALL query_vector_index('vecs', $v, 10) YIELD rank, id, distance RETURN rank, id, round(distance, 9) AS distance", {"v": [float(x) for x in v]})


text("vector_functions", "MATCH (a:Vector {vec_id: 1}), (b:Vector) RETURN b.vec_id AS k, round(array_cosine_similarity(a.embedding, b.embedding), 9) AS c, round(array_distance(a.embedding, b.embedding), 9) AS d, round(array_inner_product(a.embedding, b.embedding), 9) AS i, array_length(array_normalize(b.embedding)) AS n",
     "SELECT b.vec_id AS k, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS i, 64::BIGINT AS n FROM embeddings a, embeddings b WHERE a.vec_id = 1")


# ---------------------------------------------------------------- shards
def _orders(g: GraphSession) -> DataFrame:
    return shard.graph_nodes(g.spark, g.catalog).where("table = 'Order'")


@code("shard_histogram", "SELECT s AS start, s + 50000 AS \"end\", n AS count, n / sum(n) OVER () AS share FROM (SELECT floor(o_totalprice / 50000) * 50000 AS s, count(*) AS n FROM orders GROUP BY 1)")
def _histogram(g: GraphSession) -> DataFrame:
    return shard.histogram(_orders(g), "o_totalprice", 50000)


@code("shard_time_buckets", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS count FROM orders GROUP BY 1")
def _time(g: GraphSession) -> DataFrame:
    return shard.time_buckets(_orders(g), "o_orderdate", "month")


@code("shard_filter_page", "SELECT 'Order:' || o_orderkey AS id FROM orders WHERE o_totalprice >= 400000 OR o_orderstatus = 'P' ORDER BY o_totalprice DESC LIMIT 20")
def _filter(g: GraphSession) -> DataFrame:
    test = shard.any_of(shard.condition("o_totalprice", ">=", 400000), shard.condition("o_orderstatus", "=", "P"))
    rows = _orders(g).where(test).withColumn("price", F.col("props")["o_totalprice"].cast("double"))
    return shard.page(rows, "price", ascending=False, limit=20).select("id")


@code("shard_aggregate", "SELECT o_orderstatus, count(*) AS count, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1")
def _aggregate(g: GraphSession) -> DataFrame:
    return shard.aggregate(_orders(g), ["o_orderstatus"], ["o_totalprice"])


@code("shard_relationship_rank", "WITH n AS (SELECT 'IN_REGION' AS type, count(*) AS count FROM nation UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'SOLD_BY', count(*) FROM lineitem) SELECT type, count, rank() OVER (ORDER BY count DESC) AS rank, count / sum(count) OVER () AS share, sum(count) OVER (ORDER BY count DESC, type) AS cumulative_count, sum(count) OVER (ORDER BY count DESC, type) / sum(count) OVER () AS cumulative_share FROM n")
def _rank(g: GraphSession) -> DataFrame:
    s = shard.Shard.whole(g.spark, g.catalog).relationship_summary().where("type in ('IN_REGION', 'PLACED', 'SOLD_BY')")
    return shard.rank(s)


@code("shard_neighborhood", "SELECT 'Nation' AS t, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'Region', 1 UNION ALL SELECT 'Customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def _neighborhood(g: GraphSession) -> DataFrame:
    return shard.Shard.neighborhood(g.spark, g.catalog, ["Region:2"], 2).nodes.groupBy(F.col("table").alias("t")).agg(F.count("*").alias("n"))


@code("shard_changes", "SELECT 'Customer' AS \"table\", 0::BIGINT AS added, 0::BIGINT AS removed, count(*) FILTER (c_acctbal < 0) AS changed, count(*) FILTER (c_acctbal >= 0) AS same, 0::BIGINT AS delta FROM customer UNION ALL SELECT 'Region', 1, 0, 0, count(*), 1 FROM region")
def _changes(g: GraphSession) -> DataFrame:
    before = shard.Shard.whole(g.spark, g.catalog)
    g.cypher("MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 1.0")
    g.cypher("CREATE (r:Region {r_regionkey: 99, r_name: 'X'})")
    keep = "table in ('Customer', 'Region')"
    nodes, _ = shard.Shard(before.nodes.where(keep), before.rels).changes(shard.Shard(shard.graph_nodes(g.spark, g.catalog).where(keep), before.rels))
    return shard.change_summary(nodes, "table")


@code("shard_compare", "WITH a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) SELECT coalesce(a.s, b.s) AS s, coalesce(a.n, 0)::BIGINT AS before, coalesce(b.n, 0)::BIGINT AS after, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM a FULL JOIN b ON a.s = b.s")
def _compare(g: GraphSession) -> DataFrame:
    o = g.catalog.node("Order").df
    by = lambda y: o.where(F.year("o_orderdate") == y).groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("count"))
    return shard.compare(by(1995), by(1996), ["s"])

