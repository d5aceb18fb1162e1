"""The provided tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pelagraph.session import GraphSession


#: Schemas by path, as a metastore would keep them: reading a table's footer again costs more than planning.
_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def test_graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    t = lambda n: read(spark, f"{sf_dir}/{n}.parquet")
    region, nation, customer, supplier, part, orders, lineitem, events = map(t, "region nation customer supplier part orders lineitem events".split())
    g = GraphSession(spark)
    for label, df, key in (("Region", region, "r_regionkey"), ("Nation", nation, "n_nationkey"), ("Customer", customer, "c_custkey"), ("Supplier", supplier, "s_suppkey"), ("Part", part, "p_partkey"), ("Order", orders, "o_orderkey"), ("Event", events, "event_id"), ("Document", t("documents"), "doc_id"), ("Vector", t("embeddings"), "vec_id")):
        g.node_table(label, df, key)
    g.node_table("User", events.select("user_id").distinct(), "user_id")
    g.rel_table("IN_REGION", "Nation", "Region", nation, "n_nationkey", "n_regionkey", [])
    g.rel_table("IN_NATION", "Customer", "Nation", customer, "c_custkey", "c_nationkey", [])
    g.rel_table("IN_NATION", "Supplier", "Nation", supplier, "s_suppkey", "s_nationkey", [])
    g.rel_table("PLACED", "Customer", "Order", orders, "o_custkey", "o_orderkey", [])
    line = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    g.rel_table("HAS_PART", "Order", "Part", lineitem, "l_orderkey", "l_partkey", line)
    g.rel_table("SOLD_BY", "Order", "Supplier", lineitem, "l_orderkey", "l_suppkey", line)
    g.rel_table("DID", "User", "Event", events, "user_id", "event_id", [])
    parts = lineitem.select("l_orderkey", "l_partkey").distinct()  # an order has few lines, so few pairs
    pairs = parts.alias("a").join(parts.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey").select(F.col("a.l_partkey").alias("x"), F.col("b.l_partkey").alias("y")).distinct()
    g.rel_table("CO_ORDERED", "Part", "Part", pairs, "x", "y", [])
    return g
