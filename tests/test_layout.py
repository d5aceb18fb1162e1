"""The plans that queries get, and the library without its training-data operators."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from pelagraph.plans import registry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def scans(df, table):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"Relation \[[^\]]*{table}[^\]]*\] parquet", plan))


@pytest.mark.parametrize(
    "query,column,most",
    [
        ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 5 RETURN c.c_mktsegment AS s, sum(o.o_totalprice) AS t", "o_orderkey", 1),
        ("MATCH (o:Order)<-[:PLACED]-(c:Customer) RETURN o.o_orderstatus AS s, count(*) AS n", "o_orderkey", 1),
        ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "n_nationkey", 1),
        ("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.s_name AS s, n.n_name AS n, r.r_name AS r", "s_suppkey", 1),
        ("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.s_name AS s, n.n_name AS n, r.r_name AS r", "n_nationkey", 2),
    ],
)
def test_a_foreign_key_is_read_with_its_node(graph, query, column, most):
    assert scans(graph.cypher(query), column) == most


def test_a_changed_node_is_joined_again(spark, graph):
    from pelagraph.plans.testgraph import test_graph

    g = test_graph(spark, SF)
    g.cypher("MATCH (n:Nation) SET n.n_name = 'x'")
    rows = g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r").collect()
    assert len(rows) == 25 and {r.n for r in rows} == {"x"} and len({r.r for r in rows}) == 5


def test_all_registered_queries_have_their_columns_named():
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in registry.QUERIES)
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_training_data_operators(tmp_path, pipeline):
    """Both folders go; the pipeline's file may or may not go with them."""
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'flagship_segment_orders' in q and set(o) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")})
