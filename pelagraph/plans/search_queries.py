"""Full-text, vector and shard queries beyond the plain ones, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagraph.operators import search, shard
from pelagraph.session import GraphSession

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
#: Words in order without stop words, lengths, and the whole table's numbers.
_BASE = f"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP})) AS ws FROM documents),
len AS (SELECT doc_id, len(ws) AS n FROM l), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
k AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l)"""
_SCORE = "sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)))"


def _terms(words: str, name: str = "w") -> str:
    return f"tf AS (SELECT doc_id, {name} AS w, count(*) AS tf FROM k WHERE w IN ({words}) GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1)"


CONJUNCTIVE = f"{_BASE}, {_terms("'license', 'version'")} SELECT doc_id AS node, round({_SCORE}, 9) AS score FROM tf JOIN df USING (w) JOIN len USING (doc_id), s GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, node LIMIT 50"
PHRASE = f"""{_BASE}, {_terms("'apache', 'license', 'version'")},
b AS (SELECT a.doc_id, 2.0 * count(*) AS bonus FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND (a.w = 'apache' AND b.w = 'license' OR a.w = 'license' AND b.w = 'version') GROUP BY 1),
r AS (SELECT doc_id, {_SCORE} AS score FROM tf JOIN df USING (w) JOIN len USING (doc_id), s GROUP BY 1)
SELECT r.doc_id AS node, round(score + coalesce(bonus, 0), 9) AS score FROM r LEFT JOIN b USING (doc_id) ORDER BY score DESC, node LIMIT 50"""
#: The words of the documents that the stemmer brings to the query's stems.
STEMMED = f"{_BASE}, {_terms("'license', 'licensed', 'licenses', 'licensing', 'version', 'versions'", "CASE WHEN starts_with(w, 'licens') THEN 'licens' ELSE 'version' END")} SELECT doc_id AS node, round({_SCORE}, 9) AS score FROM tf JOIN df USING (w) JOIN len USING (doc_id), s GROUP BY 1 ORDER BY score DESC, node LIMIT 50"


def _fts(query: str, mode: str, stemmed: bool) -> Callable[[GraphSession], DataFrame]:
    def run(g: GraphSession) -> DataFrame:
        g.cypher(f"CALL create_fts_index('Document', 'docs', ['text'], {str(stemmed).lower()}) RETURN result")
        return g.cypher(f"CALL query_fts_index('docs', '{query}', 50, '{mode}') YIELD node, score RETURN node, round(score, 9) AS score")

    return run


def _fts_rebuilt(g: GraphSession) -> DataFrame:
    """The index follows the table when it is rebuilt, and is gone when it is dropped."""
    g.cypher("CALL create_fts_index('Region', 'names', ['r_name'], false) RETURN result")
    g.cypher("CREATE (r:Region {r_regionkey: 77, r_name: 'Atlantis asia'})")
    g.cypher("CALL rebuild_fts_index('names') RETURN result")
    found = g.cypher("CALL query_fts_index('names', 'asia atlantis', 5) YIELD node RETURN node")
    g.cypher("CALL drop_fts_index('names') RETURN result")
    return found


def _vector(metric: str) -> Callable[[GraphSession], DataFrame]:
    def run(g: GraphSession) -> DataFrame:
        v = [float(x) for x in g.catalog.node("Vector").df.where("vec_id = 11").first()["embedding"]]
        g.cypher(f"CALL create_vector_index('Vector', 'vecs', 'embedding', '{metric}') RETURN result")
        return g.cypher("CALL query_vector_index('vecs', $v, 15) YIELD rank, id, distance RETURN rank, id, round(distance, 9) AS distance", {"v": v})

    return run


def _vector_sql(distance: str) -> str:
    return f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 11) SELECT row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id AS id, round(d, 9) AS distance FROM (SELECT vec_id, {distance} AS d FROM embeddings, q) ORDER BY d, vec_id LIMIT 15"


# ---------------------------------------------------------------- shards
def _tables(g: GraphSession, *names: str) -> DataFrame:
    return shard.graph_nodes(g.spark, g.catalog).where(F.col("table").isin(*names))


def _regions(g: GraphSession, *keys: int) -> shard.Shard:
    return shard.Shard.neighborhood(g.spark, g.catalog, [f"Region:{k}" for k in keys], 1)


def _merge(g: GraphSession) -> DataFrame:
    both = _regions(g, 0, 1).merge(_regions(g, 1, 2))
    return both.nodes.groupBy("table").agg(F.count("*").alias("n"))


def _validate(g: GraphSession) -> DataFrame:
    """A shard that lacks its regions: each relationship that is no boundary has lost its target."""
    s = _regions(g, 0, 1)
    broken = shard.Shard(s.nodes.where("table <> 'Region'").unionByName(s.nodes.where("id = 'Nation:0'")), s.rels)
    return broken.normalize().validate().groupBy("problem").agg(F.count("*").alias("n"))


def _filters(g: GraphSession) -> DataFrame:
    s = shard.Shard(_tables(g, "Nation", "Region"), shard.graph_rels(g.spark, g.catalog).where("type = 'IN_REGION'"))
    part = s.filtered(shard.all_of(shard.any_of(shard.condition("table", "=", "Region"), shard.in_range("n_nationkey", 5, 15)), shard.condition("id", "not_in", ["Region:4"])))
    ends = s.by_relationships(shard.condition("target", "in", ["Region:1", "Region:2"]))
    return part.rels.select(F.lit("part").alias("of"), "source", "target").unionByName(ends.rels.select(F.lit("ends").alias("of"), "source", "target"))


def _cursor(g: GraphSession) -> DataFrame:
    rows = _tables(g, "Customer")
    return shard.cursor_page(rows, "Customer:5", 20).select("id").unionByName(rows.where(shard.in_bucket("c_acctbal", 1000, 2000)).select("id"))


def _path(g: GraphSession) -> DataFrame:
    s = shard.Shard(_tables(g, "Customer", "Nation", "Region"), shard.graph_rels(g.spark, g.catalog).where("type in ('IN_NATION', 'IN_REGION')"))
    ids = s.find_path("Customer:3", "Region:" + str(g.cypher("MATCH (c:Customer {c_custkey: 3})-[:IN_NATION]->(n:Nation) RETURN n.n_regionkey AS r").first()[0]))
    return s.project_path(ids).nodes.select("id", "table")


def _around(g: GraphSession) -> DataFrame:
    s = shard.Shard(_tables(g, "Nation", "Region"), shard.graph_rels(g.spark, g.catalog).where("type = 'IN_REGION'"))
    return s.around("Region:3", 1).nodes.select("id").unionByName(s.expand("Region:3", ["IN_REGION"]).select("id"))


def _neighbours(g: GraphSession) -> DataFrame:
    s = shard.Shard(_tables(g, "Customer", "Nation"), shard.graph_rels(g.spark, g.catalog).where("type = 'IN_NATION' and source like 'Customer:%'"))
    return shard.rank(s.neighbor_summary("Customer").select("id", "count")).select("id", "count", "rank", "cumulative_count")


def _chosen(g: GraphSession) -> DataFrame:
    p = _tables(g, "Part")
    return shard.selections({"big": p.where(shard.condition("p_size", ">", 30)), "dear": p.where(shard.condition("p_retailprice", ">=", 1000)), "brand": p.where(shard.condition("p_brand", "starts_with", "Brand#1"))})


_CHOSEN = "WITH c AS (SELECT 'big' AS s, p_partkey AS k FROM part WHERE p_size > 30 UNION ALL SELECT 'dear', p_partkey FROM part WHERE p_retailprice >= 1000 UNION ALL SELECT 'brand', p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')), sig AS (SELECT k, string_agg(s, '|' ORDER BY s) AS sg, count(*) AS n FROM c GROUP BY 1)"


def _transitions(g: GraphSession) -> DataFrame:
    chosen = _chosen(g)
    return shard.transition_summary(shard.transitions(chosen, chosen.where("selection <> 'big'")))


def _steps(g: GraphSession) -> list[tuple[str, shard.Shard]]:
    rels = shard.graph_rels(g.spark, g.catalog).limit(0)
    out = [("one", shard.Shard(_tables(g, "Customer", "Region"), rels))]
    g.cypher("MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 1.0")
    out.append(("two", shard.Shard(_tables(g, "Customer", "Region"), rels)))
    g.cypher("CREATE (r:Region {r_regionkey: 99, r_name: 'X'})")
    out.append(("three", shard.Shard(_tables(g, "Customer", "Region"), rels)))
    return out


_SERIES = """WITH c AS (SELECT count(*) FILTER (c_acctbal < 0) AS low, count(*) AS n FROM customer), r AS (SELECT count(*) AS n FROM region),
x(b, a, ch, added) AS (VALUES ('one', 'two', 1, 0), ('two', 'three', 0, 1), ('one', 'three', 1, 1)),
m AS (SELECT b AS before, a AS after, 'Customer' AS name, 0::BIGINT AS added, 0::BIGINT AS removed, low * ch AS changed, n - low * ch AS same, 0::BIGINT AS delta FROM x, c
UNION ALL SELECT b, a, 'Region', added, 0, 0, n, added FROM x, r)"""


def _review(g: GraphSession) -> DataFrame:
    steps = _steps(g)
    found = shard.review(steps[0][1], steps[2][1], 5)
    rows = shard.drilldown(found["nodes"], "table", ["Customer", "Region"], ["added", "changed"]).select(F.lit("rows").alias("of"), "id")
    return rows.unionByName(found["top_gaining_node_tables"].select(F.lit("gaining").alias("of"), F.col("table").alias("id")))


def _deltas(g: GraphSession) -> DataFrame:
    o = g.catalog.node("Order").df
    by = lambda y: o.where(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("count"))
    return shard.rank_deltas(shard.compare(by(1995), by(1997), ["p", "s"]))


def register(text: Callable[..., None], code: Callable[..., Callable]) -> None:
    code("fts_conjunctive", CONJUNCTIVE)(_fts("license version", "conjunctive", False))
    code("fts_phrase", PHRASE)(_fts("apache license version", "phrase", False))
    code("fts_stemmed", STEMMED)(_fts("Licensing versions", "disjunctive", True))
    code("fts_rebuild_drop", "SELECT 77 AS node UNION ALL SELECT r_regionkey FROM region WHERE lower(r_name) = 'asia'")(_fts_rebuilt)
    code("vector_query_l2", _vector_sql("list_distance(embedding::DOUBLE[], q.e::DOUBLE[])"))(_vector("l2"))
    code("vector_query_dot", _vector_sql("-list_inner_product(embedding::DOUBLE[], q.e::DOUBLE[])"))(_vector("dotproduct"))
    code("shard_merge", "SELECT 'Region' AS \"table\", 3::BIGINT AS n UNION ALL SELECT 'Nation', count(*) FROM nation WHERE n_regionkey IN (0, 1, 2)")(_merge)
    code("shard_validate", "SELECT 'missing target' AS problem, count(*) AS n FROM nation WHERE n_regionkey IN (0, 1)")(_validate)
    code("shard_filters", "SELECT 'part' AS \"of\", 'Nation:' || n_nationkey AS source, 'Region:' || n_regionkey AS target FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 15 AND n_regionkey <> 4 UNION ALL SELECT 'ends', 'Nation:' || n_nationkey, 'Region:' || n_regionkey FROM nation WHERE n_regionkey IN (1, 2)")(_filters)
    code("shard_cursor_bucket", "(SELECT 'Customer:' || c_custkey AS id FROM customer WHERE 'Customer:' || c_custkey > 'Customer:5' ORDER BY 1 LIMIT 20) UNION ALL SELECT 'Customer:' || c_custkey FROM customer WHERE c_acctbal >= 2000 AND c_acctbal < 3000")(_cursor)
    code("shard_path", "SELECT 'Customer:3' AS id, 'Customer' AS \"table\" UNION ALL SELECT 'Nation:' || c_nationkey, 'Nation' FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'Region:' || n_regionkey, 'Region' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 3")(_path)
    code("shard_around_expand", "SELECT 'Region:3' AS id UNION ALL SELECT 'Nation:' || n_nationkey FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'Nation:' || n_nationkey FROM nation WHERE n_regionkey = 3")(_around)
    code("shard_neighbor_rank", "WITH n AS (SELECT 'Nation:' || c_nationkey AS id, count(*) AS count FROM customer GROUP BY 1) SELECT id, count, rank() OVER (ORDER BY count DESC) AS rank, (sum(count) OVER (ORDER BY count DESC, id))::BIGINT AS cumulative_count FROM n")(_neighbours)
    code("shard_overlap", f"{_CHOSEN} SELECT a.s AS a, b.s AS b, count(*) AS common, count(*) / ((SELECT count(*) FROM c WHERE s = a.s) + (SELECT count(*) FROM c WHERE s = b.s) - count(*)) AS jaccard FROM c a JOIN c b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2")(lambda g: shard.overlap(_chosen(g)))
    code("shard_consensus", f"{_CHOSEN} SELECT 'Part:' || k AS id, n AS selections FROM sig WHERE n >= 2")(lambda g: shard.consensus(_chosen(g), 0.6))
    code("shard_families", f"{_CHOSEN} SELECT sg AS signature, count(*) AS count FROM sig GROUP BY 1")(lambda g: shard.families(_chosen(g)))
    code("shard_transitions", f"{_CHOSEN} SELECT sg AS before, coalesce(array_to_string(list_filter(string_split(sg, '|'), lambda x: x <> 'big'), '|'), '') AS after, count(*) AS count FROM sig GROUP BY 1, 2")(_transitions)
    code("shard_review_series", f"{_SERIES} SELECT after AS step, 'node' AS kind, name, added::BIGINT AS added, removed, changed::BIGINT AS changed, same, delta::BIGINT AS delta FROM m WHERE (before, after) IN (('one', 'two'), ('two', 'three'))")(lambda g: shard.review_series(_steps(g)))
    code("shard_review_matrix", f"{_SERIES} SELECT before, after, 'node' AS kind, name, added::BIGINT AS added, removed, changed::BIGINT AS changed, same, delta::BIGINT AS delta FROM m")(lambda g: shard.review_matrix(_steps(g)))
    code("shard_review_drilldown", "SELECT 'rows' AS \"of\", 'Customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL VALUES ('rows', 'Region:99'), ('gaining', 'Region')")(_review)
    code("shard_rank_deltas", "WITH a AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1, 2), b AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2), d AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.s, b.s) AS s, coalesce(a.n, 0)::BIGINT AS before, coalesce(b.n, 0)::BIGINT AS after, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM a FULL JOIN b ON a.p = b.p AND a.s = b.s) SELECT *, rank() OVER (ORDER BY abs(delta) DESC) AS rank FROM d")(_deltas)
