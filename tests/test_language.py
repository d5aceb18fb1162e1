"""Parser, lowering, semantics, updates and errors on small hand-made graphs."""

from __future__ import annotations

import pytest

from pelagraph.plans.parser import QueryError, parse
from pelagraph.session import GraphSession


@pytest.fixture()
def g(spark):
    s = GraphSession(spark)
    s.script("""
      CREATE NODE TABLE Person(id INT64, name STRING, age INT64, PRIMARY KEY(id));
      CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64);
      CREATE (a:Person {id: 1, name: 'ann', age: 30}), (b:Person {id: 2, name: 'bob'}), (c:Person {id: 3, name: 'cy', age: 20});
      MATCH (a:Person {id: 1}), (b:Person {id: 2}) CREATE (a)-[:KNOWS {since: 2000}]->(b);
      MATCH (b:Person {id: 2}), (c:Person {id: 3}) CREATE (b)-[:KNOWS {since: 2010}]->(c);
      MATCH (c:Person {id: 3}), (a:Person {id: 1}) CREATE (c)-[:KNOWS {since: 2020}]->(a)
    """)
    return s


def rows(g, q, **p):
    return sorted((tuple(r) for r in g.cypher(q, p).collect()), key=repr)


def test_null_semantics(g):
    one = g.cypher("RETURN null = null AS a, null < 5 AS b, null > 5 AS c, NOT (null > 5) AS d, true AND null AS e, null <> 1 AS f, null <= null AS h").first()
    assert tuple(one) == (True, True, False, True, False, True, True)


def test_comparison_with_null_property(g):
    assert rows(g, "MATCH (p:Person) WHERE p.age < 25 RETURN p.id") == [(2,), (3,)]
    assert rows(g, "MATCH (p:Person) WHERE NOT (p.age > 25) RETURN p.id") == [(2,), (3,)]
    assert rows(g, "MATCH (p:Person) WHERE p.age <> 30 RETURN p.id") == [(2,), (3,)]


def test_homomorphism_and_cycles(g):
    assert g.cypher("MATCH (a:Person)-[:KNOWS]->(b:Person)<-[:KNOWS]-(c:Person) RETURN count(*) AS n").first()[0] == 3
    assert g.cypher("MATCH (a:Person)-[:KNOWS]->(b:Person)-[:KNOWS]->(c:Person)-[:KNOWS]->(a) RETURN count(*) AS n").first()[0] == 3


def test_recursive_paths_visit_no_node_twice(g):
    assert rows(g, "MATCH (a:Person {id: 1})-[r:KNOWS*]->(b:Person) RETURN b.id, length(r)") == [(2, 1), (3, 2)]


def test_undirected_self_loop_counts_twice(g):
    g.cypher("MATCH (a:Person {id: 1}) CREATE (a)-[:KNOWS {since: 1}]->(a)")
    assert g.cypher("MATCH (a:Person {id: 1})-[:KNOWS]-(b:Person {id: 1}) RETURN count(*) AS n").first()[0] == 2


def test_optional_without_shared_variable_gives_nulls(g):
    assert rows(g, "MATCH (a:Person {id: 1}) OPTIONAL MATCH (b:Person) RETURN a.id, b.id") == [(1, None)]


def test_order_of_nulls(g):
    q = "MATCH (p:Person) RETURN p.age AS a ORDER BY a "
    assert [r[0] for r in g.cypher(q).collect()] == [None, 20, 30]
    assert [r[0] for r in g.cypher(q + "DESC").collect()] == [30, 20, None]


def test_aggregates_on_nothing_and_nulls(g):
    assert tuple(g.cypher("MATCH (p:Person) WHERE p.id > 9 RETURN count(*) AS n, sum(p.age) AS s, collect(p.age) AS l").first()) == (0, None, [])
    assert tuple(g.cypher("MATCH (p:Person) RETURN count(p.age) AS n, avg(p.age) AS a, count_if(p.age > 10) AS c").first()) == (2, 25.0, 2)


def test_unwind_drops_null_and_empty(g):
    assert rows(g, "UNWIND [] AS x RETURN x") == []
    assert rows(g, "UNWIND 5 AS x RETURN x") == [(5,)]


def test_updates_and_rollback(g):
    g.cypher("BEGIN TRANSACTION")
    g.cypher("MATCH (p:Person) WHERE p.age IS NULL SET p.age = 99")
    assert rows(g, "MATCH (p:Person) RETURN p.age") == [(20,), (30,), (99,)]
    g.cypher("ROLLBACK")
    assert g.cypher("MATCH (p:Person) WHERE p.age = 99 RETURN p").count() == 0
    g.cypher("MATCH (a:Person)-[k:KNOWS]->(b:Person) WHERE k.since < 2015 DELETE k")
    assert rows(g, "MATCH (a:Person)-[k:KNOWS]->(b:Person) RETURN k.since") == [(2020,)]
    g.cypher("MATCH (p:Person {id: 3}) DETACH DELETE p")
    assert rows(g, "MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a.id") == []


def test_merge(g):
    g.cypher("UNWIND [1, 7] AS k MERGE (p:Person {id: k}) ON CREATE SET p.name = 'new' ON MATCH SET p.name = 'old'")
    assert rows(g, "MATCH (p:Person) RETURN p.id, p.name") == [(1, "old"), (2, "bob"), (3, "cy"), (7, "new")]
    for _ in range(2):
        g.cypher("MATCH (a:Person {id: 1}), (b:Person {id: 7}) MERGE (a)-[:KNOWS]->(b)")
    assert g.cypher("MATCH (:Person {id: 1})-[:KNOWS]->(:Person {id: 7}) RETURN count(*) AS n").first()[0] == 1
    with pytest.raises(Exception, match="null key"):
        g.cypher("MERGE (p:Person {id: null})")
        g.cypher("MATCH (p:Person) RETURN p.id").collect()


def test_csv_round_trip(g, tmp_path):
    out = f"{tmp_path}/people.csv"
    g.cypher(f"COPY (MATCH (p:Person) RETURN p.id AS id, p.name AS name, p.age AS age) TO '{out}'")
    g.cypher("CREATE NODE TABLE P2(id INT64, name STRING, age INT64, PRIMARY KEY(id))")
    g.cypher(f"COPY P2 FROM '{out}'")
    assert rows(g, "MATCH (p:P2) RETURN p.id, p.name") == [(1, "ann"), (2, "bob"), (3, "cy")]
    assert rows(g, f"LOAD WITH HEADERS (a INT64, b STRING, c INT64) FROM '{out}' WHERE a > 1 RETURN a, c") == [(2, None), (3, 20)]
    with pytest.raises(QueryError, match="repeated keys"):
        g.cypher(f"COPY P2 FROM '{out}'")


def test_alter_and_drop(g):
    g.cypher("ALTER TABLE Person ADD city STRING DEFAULT 'x'")
    g.cypher("ALTER TABLE Person RENAME age TO years")
    assert {tuple(r) for r in g.cypher("MATCH (p:Person) RETURN p.city, p.years").collect()} == {("x", 30), ("x", None), ("x", 20)}
    with pytest.raises(QueryError, match="used by"):
        g.cypher("DROP TABLE Person")
    g.cypher("DROP TABLE KNOWS")
    g.cypher("DROP TABLE Person")
    assert not g.catalog.nodes


def test_macros_parameters_functions(g):
    g.cypher("CREATE MACRO twice(x, by := 2) AS x * by")
    assert g.cypher("RETURN twice(4) AS a, twice(4, 3) AS b, $v + 1 AS c", {"v": 1}).first().asDict() == {"a": 8, "b": 12, "c": 2}
    from pyspark.sql import functions as F

    g.register_scalar("shout", lambda x: F.concat(F.upper(x), F.lit("!")))
    assert g.cypher("RETURN shout('a') AS s").first()[0] == "A!"
    g.register_table("three", lambda s: s.spark.range(3).withColumnRenamed("id", "n"))
    assert rows(g, "CALL three() YIELD n AS m WHERE m > 0 RETURN m") == [(1,), (2,)]
    assert g.prepare("MATCH (p:Person) WHERE p.id = $i RETURN p.name AS n")(i=2).first()[0] == "bob"
    assert g.match("(p:Person)").where("p.id > $i").returns("p.id AS i").order_by("i").parameter("i", 1).frame().count() == 2


@pytest.mark.parametrize("q", ["MATCH (p:Nobody) RETURN p", "MATCH (p:Person) RETURN p.nope", "RETURN nofunction(1)", "MATCH (p:Person) RETURN q", "MATCH (p:Person", "RETURN $missing"])
def test_errors(g, q):
    with pytest.raises(QueryError):
        g.cypher(q)


def test_explain_and_pushdown(g, graph):
    plan = "\n".join(r[0] for r in graph.cypher("EXPLAIN MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 RETURN count(*) AS n").collect())
    assert "PushedFilters" in plan and "GreaterThan(o_totalprice" in plan
    assert "c_acctbal" not in plan


def test_endpoint_table_is_not_joined_when_unused(graph):
    plan = "\n".join(r[0] for r in graph.cypher("EXPLAIN MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, count(*) AS n").collect())
    assert plan.count("Scan parquet") >= 1 and "customer.parquet" not in plan


def test_parse_tree_shapes():
    q = parse("MATCH (a:A|B)-[r:R*1..2 (x, y | WHERE y.z > 1)]->(b) RETURN DISTINCT a AS q ORDER BY q DESC SKIP 1 LIMIT 2 UNION MATCH (c) RETURN c AS q")
    rel = q.singles[0][0].patterns[0].parts[1]
    assert rel.hops == (1, 2) and rel.per_hop[:2] == ("x", "y") and q.alls == [False]


def test_recursion_over_several_tables(graph):
    got = graph.cypher("MATCH (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN label(x) AS l, count(*) AS n")
    n = graph.cypher("MATCH (c:Customer) RETURN count(*) AS n").first()[0]
    assert sorted(map(tuple, got.collect())) == [("Nation", n), ("Region", n)]
    one = graph.cypher("MATCH (r:Region {r_regionkey: 1})<-[h:IN_NATION|IN_REGION*2..2]-(c:Customer) RETURN count(*) AS n, min(length(h)) AS l").first()
    two = graph.cypher("MATCH (r:Region {r_regionkey: 1})<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(c:Customer) RETURN count(*) AS n").first()
    assert tuple(one) == (two[0], 2)
    hop = graph.cypher("MATCH (c:Customer {c_custkey: 1})-[:IN_NATION|IN_REGION*1..2 (r, x | WHERE label(x) = 'Nation')]->(y) RETURN label(y) AS l").collect()
    assert [r[0] for r in hop] == ["Nation"]


def test_submit(g):
    assert g.submit("RETURN 1 AS x").result()[0][0] == 1


@pytest.fixture()
def pair(spark):
    g = GraphSession(spark)
    g.cypher("CREATE NODE TABLE A (id INT64, n STRING, PRIMARY KEY (id))")
    g.cypher("CREATE REL TABLE R (FROM A TO A, w INT64)")
    g.cypher("CREATE (a:A {id: 1, n: 'x'})-[:R {w: 3}]->(b:A {id: 2}), (a)-[:R {w: 4}]->(b)")
    return g


def rows(g, text):
    return sorted(map(tuple, g.cypher(text).collect()), key=repr)


def test_parallel_relationships_are_told_apart(pair):
    pair.cypher("MATCH (a:A)-[r:R]->(b:A) WHERE r.w = 3 SET r.w = 30")
    assert rows(pair, "MATCH (a:A)-[r:R]->(b:A) RETURN r.w") == [(30,), (4,)]
    pair.cypher("MATCH (a:A)-[r:R]->(b:A) WHERE r.w = 4 DELETE r")
    assert rows(pair, "MATCH (a:A)-[r:R]->(b:A) RETURN r.w") == [(30,)]


def test_merge_of_relationships(pair):
    match = "MATCH (a:A {id: 1}), (b:A {id: 2}) "
    assert rows(pair, match + "MERGE (a)-[r:R {w: 99}]->(b) RETURN r.w") == [(99,)]
    assert rows(pair, match + "MERGE (a)-[r:R {w: 4}]->(b) ON MATCH SET r.w = 55 RETURN r.w") == [(55,)]
    assert rows(pair, "MATCH (a:A)-[r:R]->(b:A) RETURN r.w") == [(3,), (55,), (99,)]
    assert rows(pair, match + "MERGE (b)-[r:R]->(a) ON CREATE SET r.w = 7 RETURN r.w, type(r)") == [(7, "R")]


def test_set_and_return(pair):
    assert rows(pair, "MATCH (a:A {id: 1}) SET a.n = 'p', a.id = a.id + 10 RETURN a.id, a.n") == [(11, "p")]
    assert rows(pair, "MATCH (a:A)-[r:R]->(b:A) RETURN a.id, a.n, b.id, r.w") == [(11, "p", 2, 3), (11, "p", 2, 4)]
    assert rows(pair, "MATCH (a:A) WHERE a.id = 2 SET a = {n: 'bag'} RETURN a.id, a.n") == [(2, "bag")]
    assert rows(pair, "MATCH (a:A) SET a.n = null RETURN a.n") == [(None,), (None,)]


def test_deleted_nodes_take_their_relationships(pair):
    pair.cypher("MATCH (b:A {id: 2}) DELETE b")
    assert rows(pair, "MATCH (a:A)-[r:R]->(b:A) RETURN b.id") == [] and rows(pair, "MATCH (a:A) RETURN a.id") == [(1,)]


@pytest.mark.parametrize(
    "text",
    ["MERGE (a:A {id: 9}) RETURN nosuch.x", "CREATE (a:A {id: 1})", "UNWIND [5, 5] AS k CREATE (a:A {id: k})", "CREATE (a:A {n: 'keyless'})", "MERGE (a:A {id: 1, n: 'other'})", "MERGE (a:A {id: null})", "MATCH (a:A) SET a.id = 7", "MATCH (a:A) SET a.nosuch = 1", "MATCH (a:A) SET a = {nosuch: 1}", "CREATE (c:A {id: 40}), (d:A {id: 2})"],
)
def test_failing_statements_change_nothing(pair, text):
    before = rows(pair, "MATCH (a:A) RETURN a.id, a.n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        pair.cypher(text).collect()
    assert rows(pair, "MATCH (a:A) RETURN a.id, a.n") == before


def test_explain_changes_nothing_and_profile_runs(pair):
    pair.cypher("EXPLAIN CREATE (a:A {id: 50})")
    assert rows(pair, "MATCH (a:A) RETURN a.id") == [(1,), (2,)]
    got = [r.plan for r in pair.cypher("PROFILE MATCH (a:A) RETURN a.id").collect()]
    assert got[0] == "rows: 2" and got[1].startswith("seconds: ") and len(got) > 3


def test_updates_do_not_pile_up(pair):
    for i in range(6):
        pair.cypher(f"MATCH (a:A) WHERE a.id = 1 SET a.n = 'v{i}'")
    plan = pair.cypher("MATCH (a:A) RETURN a.id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.strip().splitlines()) <= 3 and rows(pair, "MATCH (a:A {id: 1}) RETURN a.n") == [("v5",)]
