"""Algorithms, search, embeddings, shards and streams against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from pelagraph.operators import algorithms as alg
from pelagraph.operators import search, shard
from pelagraph.operators.providers import HashProvider
from pelagraph.session import GraphSession


@pytest.fixture(scope="module")
def net(spark):
    r = random.Random(8)
    n = 60
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(110)})
    g = alg.Graph.of(spark.range(n + 3).select("id"), spark.createDataFrame([(a, b, float(1 + (a * b) % 7)) for a, b in edges], "src long, dst long, weight double"))
    return n + 3, edges, g


def reach(n, adj, s):
    seen, todo = {s}, [s]
    while todo:
        for y in adj[todo.pop()]:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_pagerank(net):
    n, edges, g = net
    out, rank = Counter(a for a, _ in edges), [1 / n] * n
    for _ in range(20):
        new = [0.15 / n + 0.85 * sum(rank[v] for v in range(n) if not out[v]) / n for _ in range(n)]
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        done = max(abs(x - y) for x, y in zip(rank, new, strict=True)) < 1e-6
        rank = new
        if done:
            break
    got = dict(map(tuple, alg.pagerank(g).collect()))
    assert all(abs(got[v] - rank[v]) < 1e-9 for v in range(n))


def test_components(net):
    n, edges, g = net
    both, fwd, back = defaultdict(list), defaultdict(list), defaultdict(list)
    for a, b in edges:
        both[a].append(b)
        both[b].append(a)
        fwd[a].append(b)
        back[b].append(a)
    assert dict(map(tuple, alg.wcc(g).collect())) == {v: min(reach(n, both, v)) for v in range(n)}
    assert dict(map(tuple, alg.scc(g).collect())) == {v: min(reach(n, fwd, v) & reach(n, back, v)) for v in range(n)}


def test_shortest_paths(net):
    n, edges, g = net
    dist = {0: 0.0}
    for _ in range(n):
        for a, b in edges:
            if a in dist and dist[a] + 1 + (a * b) % 7 < dist.get(b, math.inf):
                dist[b] = dist[a] + 1 + (a * b) % 7
    got = dict(map(tuple, alg.sssp(g, 0, weighted=True).collect()))
    assert got == {v: dist.get(v) for v in range(n)}
    for r in alg.sssp_paths(g, 0).collect():
        assert r.path[0] == 0 and r.path[-1] == r.id and r.length == r.distance and all(e in set(edges) for e in zip(r.path, r.path[1:], strict=False))
    hops = {r.id: r.hops for r in alg.k_hop(g, 0, 2).collect()}
    near = {b for a, b in edges if a == 0} - {0}
    assert {v for v, h in hops.items() if h == 1} == near and set(hops) == near | {b for a, b in edges if a in near} - {0}


def test_kcore_forest_degree_density(net):
    n, edges, g = net
    adj = defaultdict(set)
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    core, left, k = {}, {v: set(adj[v]) for v in range(n)}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    assert dict(map(tuple, alg.kcore(g).collect())) == core
    tree = [tuple(r) for r in alg.spanning_forest(g).collect()]
    comps = len({min(reach(n, adj, v)) for v in range(n)})
    assert len(tree) == n - comps and len({b for _, b in tree}) == len(tree) and all(b in adj[a] for a, b in tree)
    assert sum(r.degree for r in alg.degrees(g).collect()) == len(edges)
    assert abs(alg.density(g).first()["density"] - len(edges) / (n * (n - 1))) < 1e-12
    labels = dict(map(tuple, alg.label_propagation(g).collect()))
    assert set(labels) == set(range(n)) and set(labels.values()) == set(range(len(set(labels.values()))))


def test_empty_graph(spark):
    g = alg.Graph.of(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    for f in (alg.pagerank, alg.wcc, alg.scc, alg.kcore, alg.label_propagation, alg.spanning_forest):
        assert f(g).count() == 0


DOCS = ["red apple pie and apple cake", "green apple", "", None, "blue sky over red roof", "pie pie pie"]


def bm25(query, conjunctive=False):
    docs = [[w for w in (d or "").split() if w not in search.STOP_WORDS] for d in DOCS]
    mean, n, out = sum(map(len, docs)) / len(docs), len(docs), {}
    for i, d in enumerate(docs):
        hits = [t for t in query if t in d]
        if hits and (not conjunctive or len(hits) == len(query)):
            out[i] = sum(math.log((n - sum(t in x for x in docs) + 0.5) / (sum(t in x for x in docs) + 0.5) + 1) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in hits)
    return out


def test_bm25(spark):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "k long, t string")
    index = search.TextIndex.build(rows, "k", ["t"], stemmed=False)
    for q, c in ((["apple"], False), (["apple", "pie"], False), (["apple", "pie"], True), (["nothing"], False)):
        got = {r.doc: r.score for r in index.search(" ".join(q), conjunctive=c).collect()}
        want = bm25(q, c)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plain, phrase = (index.search("apple pie", phrase=p).collect() for p in (False, True))
    assert {r.doc: r.score for r in phrase}[0] - {r.doc: r.score for r in plain}[0] == pytest.approx(2.0)
    new = index.updated(spark.createDataFrame([(1, "pie chart"), (9, "apple")], "k long, t string"), "k")
    assert {r.doc for r in new.search("apple").collect()} == {0, 9} and new.lengths.count() == 7


def test_index_follows_a_stream(spark, tmp_path):
    from pelagraph.streaming.index import MaintainedIndex

    spark.createDataFrame([(1, "apple"), (2, "pear")], "k long, t string").write.parquet(f"{tmp_path}/in")
    kept = MaintainedIndex(search.TextIndex.build(spark.createDataFrame([(1, "plum")], "k long, t string"), "k", ["t"]), "k")
    kept.follow(spark.readStream.schema("k long, t string").parquet(f"{tmp_path}/in"), f"{tmp_path}/ck").awaitTermination()
    assert {r.doc for r in kept.index.search("apple pear plum").collect()} == {1, 2} and kept.index.search("plum").count() == 0
    before = kept.index
    kept.apply(spark.createDataFrame([(3, "plum")], "k long, t string"), 0)
    assert kept.index is before


def test_embeddings_and_indexes(spark, tmp_path):
    g = GraphSession(spark)
    g.node_table("Doc", spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "blue sky", [0.0, 2.0]), (3, None, None)], "id long, t string, v array<double>"), "id")
    with pytest.raises(ValueError, match="provider"):
        g.cypher("CALL llm_embed_nodes('Doc', 't') YIELD id RETURN id")
    g.provider = HashProvider()
    assert g.cypher("CALL llm_search_nodes('Doc', 't', 'apple red', 1) YIELD id, score RETURN id, score").first()[0] == 1
    assert g.cypher("RETURN llm_similarity('a b', 'b a') AS s").first()[0] == pytest.approx(1.0)
    assert g.cypher("CALL llm_rank_texts('sky', ['x', 'the sky'], 1) YIELD text RETURN text").first()[0] == "the sky"
    (tmp_path / "x.json").write_text('[{"k": 1, "n": "red apple"}, {"k": 2, "n": "sky"}]')
    g.cypher(f"CALL llm_ingest_json_array_to_nodes('{tmp_path}/x.json', 'J', 'k', 'n') YIELD ingested RETURN ingested").collect()
    assert g.cypher("MATCH (j:J) RETURN count(*) AS n").first()[0] == 2
    g.cypher("CALL create_vector_index('Doc', 'vi', 'v', 'l2') RETURN result")
    assert [tuple(r) for r in g.cypher("CALL query_vector_index('vi', [0.0, 1.0], 2) YIELD rank, id, distance RETURN rank, id, distance").collect()] == [(1, 2, 1.0), (2, 1, math.sqrt(2))]
    g.cypher("CALL create_fts_index('Doc', 'fi', ['t']) RETURN result")
    assert g.cypher("CALL query_fts_index('fi', 'apples', 5, 'conjunctive') YIELD node RETURN node").collect()[0][0] == 1
    assert {r.name for r in g.cypher("CALL show_indexes() YIELD name RETURN name").collect()} == {"vi", "fi"}
    g.cypher("CALL drop_fts_index('fi') RETURN result")
    assert g.cypher("CALL show_indexes() YIELD name RETURN name").count() == 1


def test_shards(spark):
    nodes = [("P:1", "P", {"v": "5", "n": "ann"}), ("P:2", "P", {"v": "15", "n": "bob"}), ("P:3", "P", {"n": "cy"}), ("Q:1", "Q", {"v": "7"})]
    rels = [("a", "P:1", "P:2", "K", {}, False), ("b", "P:2", "P:3", "K", {"w": "2"}, False), ("c", "P:3", "Q:1", "L", {}, False)]
    s = shard.Shard(spark.createDataFrame(nodes, shard._NODES), spark.createDataFrame(rels, shard._RELS))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert s.find_path("P:1", "Q:1") == ["P:1", "P:2", "P:3", "Q:1"] and s.find_path("Q:1", "P:1") == []
    assert ids(s.filtered(shard.condition("v", ">", 6)).nodes) == ["P:2", "Q:1"] and ids(s.filtered(shard.condition("table", "=", "P")).rels) == ["a", "b"]
    assert ids(s.by_relationships(shard.condition("type", "in", ["L"])).nodes) == ["P:3", "Q:1"] and ids(s.around("P:1", 1).nodes) == ["P:1", "P:2"]
    assert [tuple(r) for r in shard.histogram(s.nodes, "v", 10).orderBy("start").collect()] == [(0.0, 10.0, 2, 2 / 3), (10.0, 20.0, 1, 1 / 3)]
    assert ids(s.nodes.where(shard.in_bucket("v", 10, 10))) == ["P:2"] and ids(s.project_path(["P:1", "P:2"]).rels) == ["a"]
    assert ids(shard.page(s.nodes, "v", limit=2)) == ["P:2", "P:3"] and ids(shard.cursor_page(s.nodes, "P:2", 1)) == ["P:3"]
    back = shard.Shard.from_json(s.to_json())
    assert all(r.change == "same" for df in s.changes(back) for r in df.collect())
    other = shard.Shard(spark.createDataFrame([nodes[0], ("P:2", "P", {"v": "16"}), ("P:9", "P", {})], shard._NODES), spark.createDataFrame(rels[:1], shard._RELS))
    got = {r.table: (r.added, r.removed, r.changed, r.same) for r in shard.review(s, other)["node_tables"].collect()}
    assert got == {"P": (1, 1, 1, 1), "Q": (0, 1, 0, 0)}
    assert ids(s.merge(other).nodes) == ["P:1", "P:2", "P:3", "P:9", "Q:1"] and s.validate().count() == 0
    broken = shard.Shard(s.nodes.where("id <> 'P:2'"), s.rels)
    assert {r.problem for r in broken.validate().collect()} == {"missing source", "missing target"}
    chosen = shard.selections({"x": s.nodes.where("table = 'P'"), "y": s.nodes.where("id in ('P:1', 'Q:1')")})
    assert [tuple(r) for r in shard.overlap(chosen).collect()] == [("x", "y", 1, 0.25)] and ids(shard.consensus(chosen)) == ["P:1"]
    assert {r.signature: r["count"] for r in shard.families(chosen).collect()} == {"x": 2, "y": 1, "x|y": 1}
    moved = shard.transition_summary(shard.transitions(chosen, chosen.where("selection = 'x'")))
    assert {(r.before, r.after): r["count"] for r in moved.collect()} == {("x", "x"): 2, ("x|y", "x"): 1, ("y", ""): 1}
    assert shard.review_series([("1", s), ("2", other), ("3", s)]).count() == 8 and shard.review_matrix([("1", s), ("2", other)]).count() == 4


def test_mutation_builder(spark):
    g = GraphSession(spark)
    g.cypher("CREATE NODE TABLE A(id INT64, n STRING, PRIMARY KEY(id))")
    g.cypher("CREATE REL TABLE R(FROM A TO A, w INT64)")
    m = g.mutate().upsert_node("A", id=1, n="x").upsert_node("A", id=2).upsert_node("A", id=1, n="y").upsert_rel("R", ("A", 1), ("A", 2), w=5)
    m.apply()
    m.apply()
    assert [tuple(r) for r in g.cypher("MATCH (a:A)-[r:R]->(b:A) RETURN a.n, b.n, r.w").collect()] == [("y", None, 5)]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dotproduct"])
def test_vector_cells_are_exact(spark, metric):
    r = random.Random(9)
    rows = []
    for i in range(600):
        centre = 10 * (i % 12)
        rows.append((i, [r.gauss(centre if j == i % 3 else 1, 1.5) for j in range(6)]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, 2.0]), (1004, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    cells = search.Cells.build(df, "k", "v", metric)
    for q in (rows[5][1], [0.0] * 6, [3.0, -2.0, 1.0, 0.5, 9.0, 2.0]):
        want = [(x.id, round(x.distance, 9)) for x in search.nearest(df.where("k <> 1004"), "k", "v", q, 9, metric).collect()]
        assert [(x.id, round(x.distance, 9)) for x in cells.nearest(q, 9).where("id <> 1004").collect()] == want
    if metric == "l2":
        assert sum(f <= 5 for f in cells.floor(__import__("numpy").array(rows[5][1])).values()) < len(cells.radii) / 2  # most cells are skipped
    assert search.Cells.build(df.limit(0), "k", "v", metric) is None


def test_running_sum_and_hot_keys(spark):
    from pyspark.sql import functions as F

    from pelagraph.operators import joins

    rows = [(i, i * 7 % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = {x.k: x.s for x in joins.running_sum(df, [F.desc("n"), F.col("k")], F.col("n"), "s").collect()}
    total, want = 0, {}
    for k, n in sorted(rows, key=lambda x: (-x[1], x[0])):
        total += n
        want[k] = total
    assert got == want
    ranks = {x.k: x["rank"] for x in shard.rank(df, "n").collect()}
    assert ranks == {k: 1 + sum(m > n for _, m in rows) for k, n in rows}
    hot = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)], "a long, b long")
    side = hot.groupBy("a").agg(F.count("*").alias("deg"), F.min("b").alias("least"))
    got = sorted(map(tuple, joins.beside_hubs(hot, side, "a", "deg", 900).collect()))
    assert got == sorted((x.a, x.b, x.deg, x.least) for x in hot.join(side, "a").collect())


def test_weighted_distances_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(alg, "MERGE_ROUNDS", 2)
    edges = [(i, i + 1, 1.0) for i in range(12)] + [(0, i, 5.0 * i) for i in range(2, 12)]
    g = alg.Graph.of(spark.range(14).select("id"), spark.createDataFrame(edges, "src long, dst long, weight double"))
    assert dict(map(tuple, alg.sssp(g, 0, weighted=True).collect())) == {**{i: float(i) for i in range(13)}, 13: None}


def test_core_numbers_by_blocks(spark, monkeypatch):
    from pelagraph import storage
    from pelagraph.operators import cores

    r = random.Random(11)
    edges = [(r.randrange(70), r.randrange(70)) for _ in range(700)] + [(i, i + 1) for i in range(100, 124)] + [(3, 900), (99, 901)]  # ends that are no vertices
    pairs = spark.createDataFrame(edges + edges[:50], "src long, dst long")
    g = alg.Graph.of(spark.range(125).select("id"), pairs)
    before = len(storage._WRITTEN)
    got = dict(map(tuple, alg.kcore(g).collect()))
    assert len(storage._WRITTEN) - before < 6  # a chain is one round within a block
    assert len(got) == 125 and got[99] == 1 and got[98] == 0 and got[112] == 1
    monkeypatch.setattr(cores, "BLOCK", 200)
    assert dict(map(tuple, alg.kcore(g).collect())) == got
    named = alg.Graph.of(spark.range(125).selectExpr("concat('P:', id) AS id"), pairs.selectExpr("concat('P:', src) AS src", "concat('P:', dst) AS dst"))
    assert dict(map(tuple, alg.kcore(named).collect())) == {f"P:{k}": c for k, c in got.items()}
    monkeypatch.setattr(cores, "WIDEST", 10)
    assert dict(map(tuple, alg.kcore(g).collect())) == got
