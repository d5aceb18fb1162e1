"""Graph algorithms as iterated DataFrame jobs.

A graph is (vertices: id; edges: src, dst[, weight]); edges may repeat, and count each time. Ids have any type
that orders. Every iteration is written to the shared folder, so plans stay short and lost executors cost
little. Vertices with no edge are part of every result that covers vertices. Null ids or ends take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from pelagraph.operators.cores import core_numbers
from pelagraph.operators.joins import beside_hubs, running_sum
from pelagraph.storage import cut, drop

#: Rounds of improved distances that sssp keeps as tables of their own before it writes one of them.
MERGE_ROUNDS = 6
#: Layers of vertices without way in or out that scc takes off in one job.
TRIM_LAYERS = 4


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame) -> Graph:
        weight = [F.col("weight").cast("double").alias("weight")] if "weight" in edges.columns else []
        v = vertices.select("id").where("id is not null").distinct()
        return Graph(v, edges.select("src", "dst", *weight).where("src is not null and dst is not null"))

    def directed(self, direction: str) -> DataFrame:
        e = self.edges
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in e.columns if c == "weight"))
        return {"OUT": e, "IN": back, "BOTH": e.unionByName(back)}[direction.upper()]


def pagerank(g: Graph, iterations: int = 20, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): starts at 1/N; rank of vertices without outgoing edge is spread over all."""
    degree = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(g.edges.join(degree, "src").select("src", "dst", "degree"))
    n = g.vertices.count()
    if n == 0:
        return g.vertices.withColumn("rank", F.lit(0.0))
    sinks = g.vertices.join(degree, g.vertices["id"] == degree["src"], "left_anti").select(F.col("id").alias("sink"))
    sinks = cut(sinks)
    rank = old = cut(g.vertices.withColumn("rank", F.lit(1.0 / n)))
    for _ in range(iterations):
        dangling = rank.join(sinks, F.col("id") == F.col("sink"), "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
        given = rank.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = rank.join(given, F.col("id") == F.col("to"), "left").crossJoin(F.broadcast(dangling))  # one row
        score = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("d") / n)
        new = cut(new.select("id", F.col("rank").alias("before"), score.alias("rank")))
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
        drop(old)
        rank, old = new.select("id", "rank"), new
        if moved < tolerance:
            break
    return rank


def wcc(g: Graph) -> DataFrame:
    """(id, component_id): the smallest id of the weakly connected component, by alternating large and small stars."""
    e = cut(g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("deg")))
        large = beside_hubs(both.where("b > a"), least, "a", "deg", 2 * e.count())  # a hub's star is not dealt to one task
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e, old = cut(small.where("a <> b").distinct()), e
        drop(old, least)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return g.vertices.join(e, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component_id"))


def _relax(g: Graph, source, direction: str, weighted: bool, limit: int | None, carry_path: bool) -> DataFrame:
    """Best distance of each reached vertex; the frontier holds those whose distance has just improved."""
    e = cut(g.directed(direction), "edges")  # every round reads them
    w = F.col("weight") if weighted else F.lit(1.0)
    start = g.vertices.where(F.col("id") == F.lit(source)).withColumn("distance", F.lit(0.0))
    if carry_path:
        start = start.withColumn("path", F.array("id"))
    best = frontier = cut(start)
    fresh: list[DataFrame] = []  # improvements since best was last written
    rounds = 0
    while limit is None or rounds < limit:
        rounds += 1
        step = frontier.join(e, F.col("id") == F.col("src"))
        cols = [F.col("dst").alias("id"), (F.col("distance") + w).alias("distance")]
        if carry_path:
            cols.append(F.array_append("path", F.col("dst")).alias("path"))
        step = step.select(*cols)
        if carry_path:
            step = step.groupBy("id").agg(F.min(F.struct("distance", F.size("path").alias("n"), "path")).alias("m")).select("id", "m.distance", "m.path")
        else:
            step = step.groupBy("id").agg(F.min("distance").alias("distance"))
        known = reduce(DataFrame.unionByName, fresh, best).select(F.col("id").alias("k"), F.col("distance").alias("was"))
        if fresh and weighted:  # a vertex may be in several
            known = known.groupBy("k").agg(F.min("was").alias("was"))
        better = cut(step.join(known, F.col("id") == F.col("k"), "left").where("was is null or distance < was").drop("k", "was"))
        if better.isEmpty():
            break
        fresh.append(better)
        frontier = better
        if len(fresh) >= MERGE_ROUNDS:
            best, fresh = cut(_latest(best, fresh, weighted)), []
    return _latest(best, fresh, weighted) if fresh else best


def _latest(best: DataFrame, fresh: list[DataFrame], weighted: bool) -> DataFrame:
    """Each vertex as the last of the tables that has it: every later distance is a smaller one. Without weights only one has it."""
    every = reduce(DataFrame.unionByName, fresh, best)
    if not weighted:
        return every
    return every.groupBy("id").agg(*(F.min_by(x, "distance").alias(x) for x in every.columns if x != "id"))


def sssp(g: Graph, source, direction: str = "OUT", weighted: bool = False) -> DataFrame:
    """(id, distance): hops, or sums of weight; null where it cannot be reached."""
    best = _relax(g, source, direction, weighted, None, False).withColumnRenamed("id", "k")
    return g.vertices.join(best, F.col("id") == F.col("k"), "left").select("id", "distance")


def sssp_paths(g: Graph, source, direction: str = "OUT", weighted: bool = False) -> DataFrame:
    """(id, distance, path, length) of the reached vertices; among equal distances the shortest, then smallest path."""
    return _relax(g, source, direction, weighted, None, True).withColumn("length", (F.size("path") - 1).cast("long"))


def k_hop(g: Graph, source, hops: int, direction: str = "OUT") -> DataFrame:
    """(id, source, hops): vertices within so many hops, the source left out."""
    best = _relax(g, source, direction, False, hops, False)
    return best.where("distance > 0").select("id", F.lit(source).alias("source"), F.col("distance").cast("long").alias("hops"))


def paths(g: Graph, source, longest: int, direction: str = "OUT") -> DataFrame:
    """(source, target, length, path): every path of 1 to longest hops that repeats no vertex."""
    e = cut(g.directed(direction), "edges")
    at = g.vertices.where(F.col("id") == F.lit(source)).select(F.col("id").alias("end"), F.array("id").alias("path"))
    found = None
    for _ in range(longest):
        at = at.join(e, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("end"), F.array_append("path", F.col("dst")).alias("path"))
        at = cut(at)
        found = at if found is None else found.unionByName(at)
        if at.isEmpty():
            break
    if found is None:
        found = at.limit(0)
    return found.select(F.lit(source).alias("source"), F.col("end").alias("target"), (F.size("path") - 1).cast("long").alias("length"), "path")


def label_propagation(g: Graph, rounds: int = 10) -> DataFrame:
    """(id, community_id): each vertex joins its neighbours' most frequent community (ties: the smallest), undirected.

    All vertices move at once, so the result does not depend on an order of visits; a vertex keeps its
    community if that is as frequent as any. Communities are numbered from 0 by their smallest label.
    """
    e = cut(g.directed("BOTH").where("src <> dst").select("src", "dst"))
    label = cut(g.vertices.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = e.join(label, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.count("*").alias("n"))
        own = label.select(F.col("id").alias("me"), F.col("label").alias("mine"))
        top = votes.join(own, F.col("src") == F.col("me")).groupBy("src").agg(F.min(F.struct(-F.col("n"), (F.col("label") != F.col("mine")).cast("int").alias("moves"), "label")).alias("best")).select(F.col("src").alias("k"), F.col("best.label").alias("new"))
        new = cut(label.join(top, F.col("id") == F.col("k"), "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        label = new.select("id", "label")
        if not moved:
            break
    numbers = _numbered(label.select("label").distinct(), "label", "community_id")
    return label.join(numbers, "label").select("id", "community_id")


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with 0, 1, … in the order of key."""
    return running_sum(rows, [F.col(key)], F.lit(1), name).withColumn(name, (F.col(name) - 1).cast("long"))


def scc(g: Graph) -> DataFrame:
    """(id, component_id): smallest id of the strongly connected component.

    Vertices that lack a way in or out are components of their own and leave, layer by layer, some layers in one
    job. Colouring: each vertex takes the smallest id that reaches it; those of a colour that reach its root backwards
    are one component and leave.
    """
    left = cut(g.vertices)
    e = cut(g.edges.where("src <> dst").select("src", "dst").distinct())
    done: DataFrame | None = None

    def add(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    while not left.isEmpty():
        inner, inner_e = left, e
        for _ in range(TRIM_LAYERS):
            inner = inner.join(inner_e.select("src"), F.col("id") == F.col("src"), "left_semi").join(inner_e.select("dst"), F.col("id") == F.col("dst"), "left_semi")
            keep = inner.select(F.col("id").alias("k"))
            inner_e = inner_e.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi")
        inner = cut(inner)
        alone = cut(left.join(inner.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left_anti"))
        if not alone.isEmpty():
            add(alone.select("id", F.col("id").alias("component_id")))
            left = inner
            e = _within(e, left)
            continue
        colour = cut(left.select("id", F.col("id").alias("colour")))
        while True:
            got = e.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("colour").alias("got"))
            new = cut(colour.join(got, F.col("id") == F.col("dst"), "left").select("id", F.least("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") < F.col("colour")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            colour = new.select("id", "colour")
            if not moved:
                break
        same = e.join(colour, F.col("src") == F.col("id")).select("src", "dst", F.col("colour").alias("c1"))
        same = cut(same.join(colour, F.col("dst") == F.col("id")).where("c1 = colour").select("src", "dst"))
        found = cut(colour.where("id = colour"))
        front = found
        while True:
            back = same.join(front.select(F.col("id").alias("k"), "colour"), F.col("dst") == F.col("k")).select(F.col("src").alias("id"), "colour").distinct()
            front = cut(back.join(found.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        add(found.select("id", F.col("colour").alias("component_id")))
        left = cut(left.join(found.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti"))
        e = _within(e, left)
    return done if done is not None else g.vertices.select("id", F.col("id").alias("component_id"))


def _within(e: DataFrame, left: DataFrame) -> DataFrame:
    keep = left.select(F.col("id").alias("k"))
    return cut(e.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi"))


def kcore(g: Graph) -> DataFrame:
    """(id, core_number), undirected, each pair of neighbours once; by blocks of vertices, or by rounds over all edges."""
    e, v = cut(g.edges.where("src <> dst").select("src", "dst"), "edges"), g.vertices
    kind, numbers = v.schema["id"].dataType, None
    if not all(isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType)) for f in (*v.schema.fields, *e.schema.fields)):
        numbers = cut(_numbered(v.unionByName(e.select(F.col("src").alias("id"))).unionByName(e.select(F.col("dst").alias("id"))).distinct(), "id", "no"), "numbers")
        v = numbers.join(v, "id", "left_semi").select(F.col("no").alias("id"))
        for end in ("src", "dst"):
            e = e.join(numbers.select(F.col("id").alias(end), F.col("no").alias(f"{end}_no")), end)
        e = cut(e.select(F.col("src_no").alias("src"), F.col("dst_no").alias("dst")), "edges")
    found = core_numbers(v.select(F.col("id").cast("long")), e.select(F.col("src").cast("long"), F.col("dst").cast("long")))
    if found is None:
        return _kcore_rounds(g)
    if numbers is not None:
        found = found.withColumnRenamed("id", "no").join(numbers, "no")
    return found.select(F.col("id").cast(kind), F.col("core").alias("core_number"))


def _kcore_rounds(g: Graph) -> DataFrame:
    """Every vertex lowers its number to the h-index of its neighbours' numbers until none changes; no task holds all of a vertex's neighbours."""
    e = cut(g.directed("BOTH").where("src <> dst").select("src", "dst").distinct())
    core = cut(g.vertices.join(e.groupBy("src").agg(F.count("*").alias("n")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("core")))
    w = W.partitionBy("src").orderBy(F.desc("c"))
    while True:
        near = e.join(core.select(F.col("id").alias("k"), F.col("core").alias("c")), F.col("dst") == F.col("k"))
        ranked = near.groupBy("src", "c").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
        h = ranked.groupBy("src").agg(F.max(F.least("c", "upto")).alias("h"))
        new = cut(core.join(h, F.col("id") == F.col("src"), "left").select("id", F.least("core", F.coalesce("h", "core")).alias("core"), (F.coalesce("h", "core") < F.col("core")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        core = new.select("id", "core")
        if not moved:
            return core.select("id", F.col("core").alias("core_number"))


def spanning_forest(g: Graph) -> DataFrame:
    """(src_id, dst_id): breadth-first trees from each component's smallest id; a vertex's parent is the smallest possible."""
    e = cut(g.directed("BOTH").where("src <> dst").select("src", "dst").distinct())
    seen = front = cut(wcc(g).where("id = component_id").select("id"))
    out: DataFrame | None = None
    while True:
        step = e.join(front, F.col("src") == F.col("id")).drop("id").join(seen, F.col("dst") == F.col("id"), "left_anti")
        step = cut(step.groupBy("dst").agg(F.min("src").alias("parent")))
        if step.isEmpty():
            break
        tree = step.select(F.col("parent").alias("src_id"), F.col("dst").alias("dst_id"))
        out = tree if out is None else out.unionByName(tree)
        front = step.select(F.col("dst").alias("id"))
        seen = cut(seen.unionByName(front))
    return out if out is not None else e.limit(0).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))


def degrees(g: Graph, direction: str = "OUT") -> DataFrame:
    """(id, degree); zero for vertices without edge."""
    n = g.directed(direction).groupBy("src").agg(F.count("*").alias("n"))
    return g.vertices.join(n, F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def density(g: Graph) -> DataFrame:
    """(vertices, edges, density); density 0 below two vertices."""
    n = g.vertices.agg(F.count("*").alias("vertices"))
    m = g.edges.agg(F.count("*").alias("edges"))
    both = n.crossJoin(m)  # one row each
    pairs = F.col("vertices") * (F.col("vertices") - 1)
    return both.withColumn("density", F.when(F.col("vertices") < 2, F.lit(0.0)).otherwise(F.col("edges") / pairs))


def has_path(g: Graph, source, target, most: int = 10) -> bool:
    return bool(_relax(g, source, "OUT", False, most, False).where(F.col("id") == F.lit(target)).limit(1).count())
