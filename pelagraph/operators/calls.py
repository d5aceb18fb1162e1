"""Table functions by name: ``f(session, *arguments) -> DataFrame``, called by ``CALL name(arguments)``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagraph.functions import SCALARS
from pelagraph.operators import algorithms as alg
from pelagraph.operators import providers, search
from pelagraph.plans.parser import QueryError
from pelagraph.sources import readers

TABLE_FUNCTIONS: dict[str, Any] = {}


def register(*names: str):
    def add(f):
        for n in names:
            TABLE_FUNCTIONS[n] = f
        return f

    return add


def frame(s: Any, rows: list[tuple], schema: str) -> DataFrame:
    return s.spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- algorithms
def graph_of(s: Any, rel: str | None = None, weight: str | None = None) -> alg.Graph:
    """The graph of one relationship table within one node table: ids are keys. Without rel: everything, ids are label:key."""
    if rel is not None:
        pairs = s.catalog.rel(rel).pairs
        if len(pairs) != 1 or pairs[0].source != pairs[0].target:
            raise QueryError(f"{rel} does not stay within one node table")
        t = s.catalog.node(pairs[0].source)
        cols = [F.col("_src").alias("src"), F.col("_dst").alias("dst"), *([F.col(weight).alias("weight")] if weight else [])]
        return alg.Graph.of(t.df.select(F.col(t.key).alias("id")), pairs[0].df.select(*cols))
    from pelagraph.operators.shard import graph_nodes, graph_rels

    return alg.Graph.of(graph_nodes(s.spark, s.catalog), graph_rels(s.spark, s.catalog).select(F.col("source").alias("src"), F.col("target").alias("dst")))


def _over(f):
    """CALL f(relationship table): results name the vertex node."""
    return lambda s, rel=None, *a: f(graph_of(s, rel), *a).withColumnRenamed("id", "node")


def _directed(f):
    """CALL f(rel, source, direction, weight)."""
    return lambda s, rel, source, direction="OUT", weight=None: f(graph_of(s, rel, weight), source, direction, weight is not None).withColumnRenamed("id", "node")


for _names, _f in {
    ("pagerank", "page_rank"): lambda s, rel=None, iterations=20, damping=0.85, tolerance=1e-6: alg.pagerank(graph_of(s, rel), iterations, damping, tolerance).withColumnRenamed("id", "node"),
    ("wcc", "weakly_connected_components"): _over(alg.wcc),
    ("scc", "strongly_connected_components"): _over(alg.scc),
    ("kcore", "k_core_decomposition"): _over(alg.kcore),
    ("louvain",): _over(alg.label_propagation),
    ("spanning_forest",): lambda s, rel=None: alg.spanning_forest(graph_of(s, rel)),
    ("sssp", "shortest_path", "all_shortest_paths", "sssp_delta", "delta_stepping"): _directed(alg.sssp),
    ("sssp_paths", "shortest_paths"): _directed(alg.sssp_paths),
    ("k_hop", "k_hop_neighbors"): lambda s, rel, source, hops, direction="OUT": alg.k_hop(graph_of(s, rel), source, hops, direction).withColumnRenamed("id", "node"),
    ("variable_length_path",): lambda s, rel, source, longest, direction="OUT": alg.paths(graph_of(s, rel), source, longest, direction),
    ("node_degree",): lambda s, rel=None, direction="OUT": alg.degrees(graph_of(s, rel), direction).withColumnRenamed("id", "node"),
    ("graph_density",): lambda s, rel=None: alg.density(graph_of(s, rel)),
    ("has_path",): lambda s, rel, a, b, most=10: frame(s, [(alg.has_path(graph_of(s, rel), a, b, most),)], "has_path boolean"),
    ("shortest_path_length", "sssp_distance"): lambda s, rel, a, b: alg.sssp(graph_of(s, rel), a).where(F.col("id") == F.lit(b)).select(F.col("distance").alias("length")),
    ("pagerank_score",): lambda s, rel, node: alg.pagerank(graph_of(s, rel)).where(F.col("id") == F.lit(node)).select("rank"),
    ("wcc_component",): lambda s, rel, node: alg.wcc(graph_of(s, rel)).where(F.col("id") == F.lit(node)).select("component_id"),
    ("k_hop_count",): lambda s, rel, node, hops: alg.k_hop(graph_of(s, rel), node, hops).agg(F.count("*").alias("count")),
    ("clear_gds_cache",): lambda s: s.done("nothing is cached"),
}.items():
    register(*_names)(_f)


# ---------------------------------------------------------------- full text
def _index(s: Any, name: str, kind: type) -> Any:
    if not isinstance(s.indexes.get(name), kind):
        raise QueryError(f"no such index: {name}")
    return s.indexes[name]


@register("create_fts_index")
def create_fts_index(s: Any, table: str, name: str, properties: list[str], stemmed: bool = True) -> DataFrame:
    if name in s.indexes:
        raise QueryError(f"index {name} exists already")
    t = s.catalog.node(table)
    s.indexes[name] = search.TextIndex.build(t.df, t.key, list(properties), stemmed, table)
    return s.done(f"created index {name}")


@register("rebuild_fts_index")
def rebuild_fts_index(s: Any, name: str) -> DataFrame:
    i = _index(s, name, search.TextIndex)
    t = s.catalog.node(i.table)
    s.indexes[name] = search.TextIndex.build(t.df, t.key, list(i.properties), i.stemmed, i.table)
    return s.done(f"rebuilt index {name}")


@register("query_fts_index")
def query_fts_index(s: Any, name: str, query: str, k: int = 10, mode: str = "disjunctive") -> DataFrame:
    i = _index(s, name, search.TextIndex)
    return i.search(query, k, mode.lower() == "conjunctive", mode.lower() == "phrase").withColumnRenamed("doc", "node")


# ---------------------------------------------------------------- vectors
class VectorIndex:
    """Cells of the table's rows as they were when it was built; a table changed since is scanned."""

    def __init__(self, s: Any, table: str, property_: str, metric: str):
        t = s.catalog.node(table)
        self.table, self.property, self.metric, self.rows = table, property_, metric, t.df
        self.cells = search.Cells.build(t.df, t.key, property_, metric)

    def nearest(self, s: Any, vector: list[float], k: int) -> DataFrame:
        t = s.catalog.node(self.table)
        if self.cells is not None and t.df is self.rows:
            return self.cells.nearest(vector, k)
        return search.nearest(t.df, t.key, self.property, vector, k, self.metric)


@register("create_vector_index")
def create_vector_index(s: Any, table: str, name: str, property_: str, metric: str = "cosine") -> DataFrame:
    if name in s.indexes:
        raise QueryError(f"index {name} exists already")
    if metric not in ("cosine", "l2", "dotproduct"):
        raise QueryError(f"no metric {metric}")
    s.indexes[name] = VectorIndex(s, table, property_, metric)
    return s.done(f"created index {name}")


@register("rebuild_vector_index")
def rebuild_vector_index(s: Any, name: str) -> DataFrame:
    i = _index(s, name, VectorIndex)
    s.indexes[name] = VectorIndex(s, i.table, i.property, i.metric)
    return s.done(f"rebuilt index {name}")


@register("drop_vector_index", "drop_fts_index")
def drop_index(s: Any, name: str) -> DataFrame:
    if s.indexes.pop(name, None) is None:
        raise QueryError(f"no such index: {name}")
    return s.done(f"dropped index {name}")


@register("query_vector_index")
def query_vector_index(s: Any, name: str, vector: list[float], k: int) -> DataFrame:
    return _index(s, name, VectorIndex).nearest(s, list(vector), k)


# ---------------------------------------------------------------- catalog
@register("show_tables")
def show_tables(s: Any) -> DataFrame:
    return frame(s, [(n, "NODE") for n in sorted(s.catalog.nodes)] + [(n, "REL") for n in sorted(s.catalog.rels)], "name string, type string")


@register("table_info")
def table_info(s: Any, name: str) -> DataFrame:
    if name in s.catalog.nodes:
        t = s.catalog.node(name)
        rows = [(i, f.name, f.dataType.simpleString(), f.name == t.key) for i, f in enumerate(t.df.schema)]
    else:
        p = s.catalog.rel(name).pairs[0]
        rows = [(i, f.name, f.dataType.simpleString(), False) for i, f in enumerate(f for f in p.df.schema if f.name not in ("_src", "_dst"))]
    return frame(s, rows, "property_id long, name string, type string, primary_key boolean")


@register("show_functions")
def show_functions(s: Any) -> DataFrame:
    return frame(s, [(n, "SCALAR") for n in sorted({*SCALARS, *s.scalar_functions})] + [(n, "TABLE") for n in sorted({*TABLE_FUNCTIONS, *s.table_functions})], "name string, type string")


@register("show_indexes")
def show_indexes(s: Any) -> DataFrame:
    return frame(s, [(n, "FTS" if isinstance(i, search.TextIndex) else "VECTOR" if isinstance(i, VectorIndex) else "PROPERTY", i.table) for n, i in sorted(s.indexes.items())], "name string, type string, table string")


@register("show_vector_indexes")
def show_vector_indexes(s: Any) -> DataFrame:
    return frame(s, [(n, i.table, i.property, i.metric) for n, i in sorted(s.indexes.items()) if isinstance(i, VectorIndex)], "name string, table string, property string, metric string")


class PropertyIndex:
    """Scans find properties by Parquet statistics; the entry only records the wish."""

    def __init__(self, table: str, property_: str):
        self.table, self.property = table, property_


@register("create_index")
def create_index(s: Any, table: str, property_: str) -> DataFrame:
    if property_ not in s.catalog.node(table).properties:
        raise QueryError(f"{table} has no property {property_}")
    s.indexes[f"{table}_{property_}"] = PropertyIndex(table, property_)
    return s.done(f"created index {table}_{property_}")


for _name, _rows in {
    "show_sequences": (lambda s: sorted(s.sequences.items()), "name string, value long"),
    "show_macros": (lambda s: [(m.name, ", ".join(n for n, _ in m.parameters)) for m in s.catalog.macros.values()], "name string, parameters string"),
    "show_attached_databases": (lambda s: [(a, k, p) for a, (p, k) in sorted(s.attached.items())], "alias string, type string, path string"),
    "show_loaded_extensions": (lambda s: [(e,) for e in sorted(s.extensions)], "name string"),
    "show_warnings": (lambda s: [(w,) for w in s.warnings], "message string"),
}.items():
    register(_name)(lambda s, f=_rows: frame(s, f[0](s), f[1]))


@register("clear_warnings")
def clear_warnings(s: Any) -> DataFrame:
    s.warnings.clear()
    return s.done("cleared")


# ---------------------------------------------------------------- files and databases
register("scan_json_array")(lambda s, path: readers.read_json(s.spark, path))
register("scan_csv")(lambda s, path: readers.read_csv(s.spark, path))
register("scan_parquet")(lambda s, path: s.spark.read.parquet(path))
register("scan_sqlite")(lambda s, path, table: readers.read_jdbc(s.spark, f"jdbc:sqlite:{path}", table))
register("scan_duckdb")(lambda s, path, table: readers.read_jdbc(s.spark, f"jdbc:duckdb:{path}", table))
register("scan_postgres")(lambda s, connection, table: readers.scan_postgres(s.spark, connection, table))


# ---------------------------------------------------------------- embeddings
def _node_vectors(s: Any, label: str, prop: str) -> DataFrame:
    return providers.embed_nodes(s, label, prop)


register("llm_embed_texts")(lambda s, texts: providers.embed_texts(s, texts))
register("llm_rank_texts")(lambda s, query, texts, k=10: providers.ranked(s, providers.embed_texts(s, texts), query, k))
register("llm_embed_nodes")(lambda s, label, prop: _node_vectors(s, label, prop))
register("llm_rank_nodes", "llm_search_nodes")(lambda s, label, prop, query, k=10: providers.ranked(s, _node_vectors(s, label, prop), query, k))
register("llm_embed_json_array")(lambda s, path, prop: providers.json_items(s, path, prop).withColumn("embedding", providers.embed(providers.need(s), F.col("text"))))
register("llm_search_json_array")(lambda s, path, prop, query, k=10: providers.ranked(s, providers.json_items(s, path, prop).select("text", providers.embed(providers.need(s), F.col("text")).alias("embedding")), query, k))
register("llm_ingest_json_array_to_nodes")(lambda s, path, label, key, prop: providers.ingest(s, path, label, key, prop))
