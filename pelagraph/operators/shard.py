"""Shards: subgraphs taken out of the graph, and the analytics on them.

A shard is two DataFrames, nodes (id, table, props) and rels (id, source, target, type, props, boundary), with
props a map of texts. Node ids are texts ``label:key``. Every method is a filter, join, aggregation or window over
these, so a shard may be as large as the graph.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagraph.catalog import Catalog
from pelagraph.operators.joins import running_sum
from pelagraph.storage import cut

_NODES = "id string, table string, props map<string,string>"
_RELS = "id string, source string, target string, type string, props map<string,string>, boundary boolean"


def _props(df: DataFrame, names: list[str]) -> Column:
    if not names:
        return F.create_map().cast("map<string,string>")
    kept = [F.create_map(F.lit(n), F.to_json(F.col(f"`{n}`")) if df.schema[n].dataType.typeName() in ("array", "struct", "map") else F.col(f"`{n}`").cast("string")) for n in names]
    return F.map_concat(*kept)


def graph_nodes(spark: SparkSession, c: Catalog) -> DataFrame:
    frames = [t.df.select(F.concat(F.lit(f"{t.label}:"), F.col(f"`{t.key}`").cast("string")).alias("id"), F.lit(t.label).alias("table"), _props(t.df, t.df.columns).alias("props")) for t in c.nodes.values()]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], _NODES)


def graph_rels(spark: SparkSession, c: Catalog) -> DataFrame:
    frames = []
    for t in c.rels.values():
        for p in t.pairs:
            a, b = F.concat(F.lit(f"{p.source}:"), F.col("_src").cast("string")), F.concat(F.lit(f"{p.target}:"), F.col("_dst").cast("string"))
            props = _props(p.df, p.properties)
            key = F.concat_ws("|", F.lit(t.name), a, b, F.to_json(props))
            frames.append(p.df.select(key.alias("id"), a.alias("source"), b.alias("target"), F.lit(t.name).alias("type"), props.alias("props"), F.lit(False).alias("boundary")))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], _RELS)


# ---------------------------------------------------------------- filters
_NUMBER: dict[str, Callable[[Column, Any], Column]] = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}


def condition(name: str, op: str, value: Any = None) -> Column:
    """A test of one property (or of table, type, id). op: = <> in not_in > >= < <= contains starts_with exists."""
    c = F.col(name) if name in ("id", "table", "type", "source", "target") else F.col("props")[name]
    if op in _NUMBER:
        if isinstance(value, (int, float)):
            return F.coalesce(_NUMBER[op](c.try_cast("double"), F.lit(float(value))), F.lit(False))
        return F.coalesce(_NUMBER[op](c, F.lit(str(value))), F.lit(False))
    if op in ("in", "not_in"):
        hit = F.coalesce(c.isin([str(v) for v in value]), F.lit(False))
        return hit if op == "in" else ~hit
    if op == "exists":
        return c.isNotNull()
    tests = {"=": lambda: c.eqNullSafe(F.lit(str(value))), "<>": lambda: ~c.eqNullSafe(F.lit(str(value))), "contains": lambda: F.coalesce(c.contains(str(value)), F.lit(False)), "starts_with": lambda: F.coalesce(c.startswith(str(value)), F.lit(False))}
    return tests[op]()


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def in_range(name: str, low: float | None, high: float | None) -> Column:
    """low included, high excluded."""
    return all_of(*([condition(name, ">=", low)] if low is not None else []), *([condition(name, "<", high)] if high is not None else []))


def in_bucket(name: str, size: float, start: float) -> Column:
    return in_range(name, start, start + size)


# ---------------------------------------------------------------- rows of either kind
def aggregate(rows: DataFrame, by: list[str], sums: list[str] = ()) -> DataFrame:
    """count, and sum of numeric properties, by properties or columns."""
    col = lambda n: F.col(n) if n in rows.columns else F.col("props")[n]
    return rows.groupBy(*(col(n).alias(n) for n in by)).agg(F.count("*").alias("count"), *(F.sum(col(n).try_cast("double")).alias(f"sum_{n}") for n in sums))


def page(rows: DataFrame, by: str, ascending: bool = True, skip: int = 0, limit: int = 100) -> DataFrame:
    c = F.col(by) if by in rows.columns else F.col("props")[by]
    return rows.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), "id").offset(skip).limit(limit)


def cursor_page(rows: DataFrame, after: str | None = None, limit: int = 100) -> DataFrame:
    """By id; after: the last id of the page before."""
    return (rows.where(F.col("id") > after) if after is not None else rows).orderBy("id").limit(limit)


def histogram(rows: DataFrame, name: str, size: float) -> DataFrame:
    """(start, end, count, share): buckets of a numeric property, start included."""
    if size <= 0:
        raise ValueError("a bucket's size has to be positive")
    x = F.col("props")[name].try_cast("double")
    n = rows.select((F.floor(x / size) * size).cast("double").alias("start")).where("start is not null").groupBy("start").agg(F.count("*").alias("count"))
    total = n.agg(F.sum("count").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("start", (F.col("start") + size).alias("end"), "count", (F.col("count") / F.col("total")).alias("share"))  # total: one row


def time_buckets(rows: DataFrame, name: str, unit: str) -> DataFrame:
    """(bucket, count); unit: hour, day, month or year."""
    if unit.lower() not in ("hour", "day", "month", "year"):
        raise ValueError(f"no time bucket {unit}")
    at = F.date_trunc(unit, F.try_to_timestamp(F.col("props")[name]))
    return rows.select(at.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("count"))


def _ranked(rows: DataFrame, by: Column) -> DataFrame:
    """rows with rank, 1 for the greatest: from the table of distinct values and how many rows have each."""
    values = rows.groupBy(by.alias("_by")).agg(F.count("*").alias("_rows"))
    places = running_sum(values, [F.desc("_by")], F.col("_rows"), "_upto").select("_by", (F.col("_upto") - F.col("_rows") + 1).cast("long").alias("rank"))
    return rows.join(places, by.eqNullSafe(F.col("_by"))).drop("_by")


def rank(summary: DataFrame, by: str = "count") -> DataFrame:
    """summary with rank, share, and both cumulated, largest first."""
    keys = [c for c in summary.columns if c != by]
    total = summary.agg(F.sum(by).alias("_total"))
    out = _ranked(summary, F.col(by)).crossJoin(F.broadcast(total)).withColumn("share", F.col(by) / F.col("_total"))  # total: one row
    out = running_sum(out, [F.desc(by), *(F.col(k) for k in keys)], F.col(by), "cumulative_count")
    return out.withColumn("cumulative_share", F.col("cumulative_count") / F.col("_total")).drop("_total")


def top(summary: DataFrame, k: int, by: str = "count", ascending: bool = False) -> DataFrame:
    keys = [c for c in summary.columns if c != by]
    return summary.orderBy(F.asc(by) if ascending else F.desc(by), *keys).limit(k)


def compare(before: DataFrame, after: DataFrame, keys: list[str], measure: str = "count") -> DataFrame:
    """(keys, before, after, delta): full outer comparison of two summaries or bucket tables."""
    a = before.groupBy(*keys).agg(F.sum(measure).alias("before"))
    b = after.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum(measure).alias("after"))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    joined = a.join(b, on, "full").select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return joined.withColumn("delta", F.col("after") - F.col("before"))


def rank_deltas(deltas: DataFrame) -> DataFrame:
    """deltas with rank, the greatest change first."""
    return _ranked(deltas, F.abs(F.col("delta")))


def gaining(deltas: DataFrame, k: int) -> DataFrame:
    return top(deltas.where("delta > 0"), k, "delta")


def declining(deltas: DataFrame, k: int) -> DataFrame:
    return top(deltas.where("delta < 0"), k, "delta", ascending=True)


# ---------------------------------------------------------------- the shard
@dataclass(frozen=True)
class Shard:
    nodes: DataFrame
    rels: DataFrame

    # -- taking and combining
    @staticmethod
    def neighborhood(spark: SparkSession, c: Catalog, roots: list[str], depth: int, max_nodes: int | None = None, max_rels: int | None = None) -> Shard:
        """Nodes within so many undirected hops of the roots, with the relationships among them.

        max_nodes and max_rels are the extraction's own bounds: nearest nodes first, then by id. A relationship
        with one end outside is kept as boundary.
        """
        nodes, rels = graph_nodes(spark, c), graph_rels(spark, c)
        ends = rels.select(F.col("source").alias("a"), F.col("target").alias("b"))
        ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        seen = front = cut(nodes.where(F.col("id").isin(roots)).select("id", F.lit(0).alias("depth")))
        for d in range(1, depth + 1):
            step = ends.join(front, F.col("a") == F.col("id")).select(F.col("b").alias("id")).distinct()
            front = cut(step.join(seen.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti").withColumn("depth", F.lit(d)))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        if max_nodes is not None:
            seen = seen.orderBy("depth", "id").limit(max_nodes)
        return Shard._cut_out(nodes, rels, seen.select("id"), max_rels)

    @staticmethod
    def node_set(spark: SparkSession, c: Catalog, ids: list[str]) -> Shard:
        return Shard._cut_out(graph_nodes(spark, c), graph_rels(spark, c), spark.createDataFrame([(i,) for i in ids], "id string"), None)

    @staticmethod
    def _cut_out(nodes: DataFrame, rels: DataFrame, ids: DataFrame, max_rels: int | None) -> Shard:
        inside = nodes.join(ids, "id", "left_semi").select("id", "table", "props")
        s, t = ids.select(F.col("id").alias("source"), F.lit(True).alias("in_s")), ids.select(F.col("id").alias("target"), F.lit(True).alias("in_t"))
        r = rels.join(s, "source", "left").join(t, "target", "left").where("in_s or in_t")
        r = r.select("id", "source", "target", "type", "props", (F.col("in_s").isNull() | F.col("in_t").isNull()).alias("boundary"))
        return Shard(inside, r.orderBy("id").limit(max_rels) if max_rels is not None else r)

    @staticmethod
    def whole(spark: SparkSession, c: Catalog) -> Shard:
        return Shard(graph_nodes(spark, c), graph_rels(spark, c))

    def merge(self, *others: Shard) -> Shard:
        """Union by id; a relationship is boundary only if it is in all of its shards."""
        n = reduce(DataFrame.unionByName, (o.nodes for o in others), self.nodes)
        r = reduce(DataFrame.unionByName, (o.rels for o in others), self.rels)
        inner = r.groupBy("id").agg(F.min("boundary").alias("b"))
        r = r.dropDuplicates(["id"]).join(inner, "id").withColumn("boundary", F.col("b")).drop("b")
        return Shard(n.dropDuplicates(["id"]), r.select(*self.rels.columns))

    def normalize(self) -> Shard:
        """One row an id; null maps become empty; blank ids and relationships without ends go."""
        empty = F.create_map().cast("map<string,string>")
        n = self.nodes.where("id is not null and id <> ''").withColumn("props", F.coalesce("props", empty)).dropDuplicates(["id"])
        r = self.rels.where("id is not null and source is not null and target is not null").withColumn("props", F.coalesce("props", empty)).dropDuplicates(["id"])
        return Shard(n, r)

    def validate(self) -> DataFrame:
        """(problem, id): repeated ids, missing tables or types, relationships whose end is missing and that are no boundary."""
        n, r = self.nodes, self.rels
        ids = n.select(F.col("id").alias("k")).distinct()
        issue = lambda df, text: df.select(F.lit(text).alias("problem"), "id")
        inner = r.where(~F.col("boundary"))
        found = [
            issue(n.groupBy("id").count().where("count > 1"), "repeated node"), issue(r.groupBy("id").count().where("count > 1"), "repeated relationship"),
            issue(n.where("table is null or table = ''"), "node without table"), issue(r.where("type is null or type = ''"), "relationship without type"),
            issue(inner.join(ids, F.col("source") == F.col("k"), "left_anti"), "missing source"), issue(inner.join(ids, F.col("target") == F.col("k"), "left_anti"), "missing target"),
        ]
        return reduce(DataFrame.unionByName, found)

    def to_json(self) -> DataFrame:
        """(kind, json): one row a node or relationship."""
        return self.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*self.nodes.columns)).alias("json")).unionByName(self.rels.select(F.lit("rel").alias("kind"), F.to_json(F.struct(*self.rels.columns)).alias("json")))

    @staticmethod
    def from_json(rows: DataFrame) -> Shard:
        part = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")
        return Shard(part("node", _NODES), part("rel", _RELS))

    @staticmethod
    def load(spark: SparkSession, text: str) -> Shard:
        """From one JSON text {nodes: [...], rels: [...]}, as small extracts are passed around."""
        got = json.loads(text)
        return Shard(spark.createDataFrame(got["nodes"], _NODES), spark.createDataFrame(got["rels"], _RELS))

    def write(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.rels.write.mode("overwrite").parquet(f"{path}/rels")

    # -- looking things up
    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def relationship(self, rel_id: str) -> DataFrame:
        return self.rels.where(F.col("id") == rel_id)

    def has_node(self, node_id: str) -> bool:
        return not self.node(node_id).isEmpty()

    def has_relationship(self, rel_id: str) -> bool:
        return not self.relationship(rel_id).isEmpty()

    def outgoing(self, node_id: str) -> DataFrame:
        return self.rels.where(F.col("source") == node_id)

    def incoming(self, node_id: str) -> DataFrame:
        return self.rels.where(F.col("target") == node_id)

    def expand(self, node_id: str, types: list[str] | None = None) -> DataFrame:
        """The nodes next to one, with the relationship that leads there."""
        r = self.rels.where(F.col("type").isin(types)) if types else self.rels
        near = r.where(F.col("source") == node_id).select(F.col("target").alias("id"), F.col("id").alias("rel_id"), "type").unionByName(r.where(F.col("target") == node_id).select(F.col("source").alias("id"), F.col("id").alias("rel_id"), "type"))
        return self.nodes.join(near, "id")

    # -- parts
    def filtered(self, nodes: Column | None = None, rels: Column | None = None) -> Shard:
        """Nodes that pass, and relationships that pass between them."""
        n = self.nodes.where(nodes) if nodes is not None else self.nodes
        r = self.rels.where(rels) if rels is not None else self.rels
        return Shard(n, self._between(r, n))

    def by_relationships(self, rels: Column) -> Shard:
        """Relationships that pass, and their ends."""
        r = self.rels.where(rels)
        ends = r.select(F.col("source").alias("k")).unionByName(r.select(F.col("target").alias("k"))).distinct()
        return Shard(self.nodes.join(ends, F.col("id") == F.col("k"), "left_semi"), r)

    def bucket(self, name: str, size: float, start: float) -> Shard:
        return self.filtered(in_bucket(name, size, start))

    @staticmethod
    def _between(r: DataFrame, n: DataFrame) -> DataFrame:
        k = n.select(F.col("id").alias("k"))
        return r.join(k, F.col("source") == F.col("k"), "left_semi").join(k, F.col("target") == F.col("k"), "left_semi")

    def around(self, root: str, depth: int) -> Shard:
        seen = front = self.nodes.where(F.col("id") == root).select("id")
        ends = self.rels.select(F.col("source").alias("a"), F.col("target").alias("b"))
        ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        for _ in range(depth):
            front = ends.join(front, F.col("a") == F.col("id")).select(F.col("b").alias("id")).distinct()
            seen = cut(seen.unionByName(front).distinct())
        n = self.nodes.join(seen, "id", "left_semi")
        return Shard(n, self._between(self.rels, n))

    def find_path(self, source: str, target: str, longest: int = 10) -> list[str]:
        """Node ids of a shortest directed path; empty if there is none."""
        e = self.rels.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
        seen = front = cut(self.nodes.where(F.col("id") == source).select("id", F.array("id").alias("path")))
        for _ in range(longest + 1):
            if hit := front.where(F.col("id") == target).select("path").first():
                return list(hit["path"])
            step = e.join(front, F.col("a") == F.col("id")).groupBy(F.col("b")).agg(F.min("path").alias("path"))
            step = step.select(F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path"))
            front = cut(step.join(seen.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti"))
            if front.isEmpty():
                return []
            seen = cut(seen.unionByName(front))
        return []

    def project_path(self, ids: list[str]) -> Shard:
        steps = list(zip(ids, ids[1:], strict=False))
        test = any_of(*((F.col("source") == a) & (F.col("target") == b) for a, b in steps))
        return Shard(self.nodes.where(F.col("id").isin(ids)), self.rels.where(test))

    # -- summaries
    def neighbor_summary(self, table: str | None = None) -> DataFrame:
        """(id, target_table, count): neighbours of each node by table, in either direction."""
        ends = self.rels.select(F.col("source").alias("id"), F.col("target").alias("k")).unionByName(self.rels.select(F.col("target").alias("id"), F.col("source").alias("k")))
        t = self.nodes.select(F.col("id").alias("k"), F.col("table").alias("target_table"))
        out = ends.join(t, "k").groupBy("id", "target_table").agg(F.count("*").alias("count"))
        return out.where(F.col("target_table") == table) if table else out

    def relationship_summary(self, of: str | None = None) -> DataFrame:
        """(type, count)"""
        out = self.rels.groupBy("type").agg(F.count("*").alias("count"))
        return out.where(F.col("type") == of) if of else out

    # -- changes
    def changes(self, after: Shard) -> tuple[DataFrame, DataFrame]:
        """(nodes, rels) with change: added, removed, changed or same."""
        return _changes(self.nodes, after.nodes, "table"), _changes(self.rels, after.rels, "type")


def _changes(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    digest = lambda df: F.sha2(F.to_json(F.array_sort(F.map_entries("props"))), 256)
    a = before.select("id", F.col(group).alias("g1"), digest(before).alias("d1"))
    b = after.select(F.col("id").alias("k"), F.col(group).alias("g2"), digest(after).alias("d2"))
    kind = F.when(F.col("id").isNull(), "added").when(F.col("k").isNull(), "removed").when(F.col("d1") != F.col("d2"), "changed").otherwise("same")
    return a.join(b, F.col("id") == F.col("k"), "full").select(F.coalesce("id", "k").alias("id"), F.coalesce("g2", "g1").alias(group), kind.alias("change"))


def change_summary(changed: DataFrame, group: str) -> DataFrame:
    """(group, added, removed, changed, same, delta)"""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    out = changed.groupBy(group).agg(n("added"), n("removed"), n("changed"), n("same"))
    return out.withColumn("delta", F.col("added") - F.col("removed"))


def review(before: Shard, after: Shard, k: int = 10) -> dict[str, DataFrame]:
    """Overview and highlights of what changed, by node table and relationship type."""
    nodes, rels = before.changes(after)
    out: dict[str, DataFrame] = {"nodes": nodes, "rels": rels}
    for name, rows, group in (("node_tables", nodes, "table"), ("rel_types", rels, "type")):
        s = change_summary(rows, group)
        touched = s.withColumn("touched", F.col("added") + F.col("removed") + F.col("changed"))
        out |= {name: s, f"top_changed_{name}": touched.orderBy(F.desc("touched"), group).limit(k), f"top_gaining_{name}": gaining(s, k), f"top_declining_{name}": declining(s, k)}
    return out


def drilldown(changed: DataFrame, group: str, values: list[str], kinds: list[str] = ("added", "removed", "changed")) -> DataFrame:
    """The changed rows of some tables or types."""
    return changed.where(F.col(group).isin(list(values)) & F.col("change").isin(list(kinds)))


# -- several named selections of changed ids
def selections(named: dict[str, DataFrame]) -> DataFrame:
    """(selection, id): each given DataFrame has ids."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("selection"), "id").distinct() for n, df in named.items()))


def overlap(chosen: DataFrame) -> DataFrame:
    """(a, b, common, jaccard) of each two selections."""
    size = chosen.groupBy("selection").agg(F.count("*").alias("n"))
    a, b = chosen.select(F.col("selection").alias("a"), "id"), chosen.select(F.col("selection").alias("b"), "id")
    both = a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    both = both.join(size.select(F.col("selection").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("selection").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def frequency(chosen: DataFrame) -> DataFrame:
    """(id, selections): in how many selections an id is."""
    return chosen.groupBy("id").agg(F.count_distinct("selection").alias("selections"))


def consensus(chosen: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Ids in at least this share of the selections."""
    n = chosen.agg(F.count_distinct("selection").alias("n"))
    return frequency(chosen).crossJoin(F.broadcast(n)).where(F.col("selections") >= F.ceil(F.col("n") * threshold)).select("id", "selections")  # n: one row


def profiles(chosen: DataFrame) -> DataFrame:
    """(id, signature): the sorted selections of an id."""
    return chosen.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("selection")), "|").alias("signature"))


def families(chosen: DataFrame) -> DataFrame:
    """(signature, count)"""
    return profiles(chosen).groupBy("signature").agg(F.count("*").alias("count"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after): signatures of two sets of selections; '' where an id is in none."""
    a, b = profiles(before).withColumnRenamed("signature", "s1"), profiles(after).select(F.col("id").alias("k"), F.col("signature").alias("s2"))
    return a.join(b, F.col("id") == F.col("k"), "full").select(F.coalesce("id", "k").alias("id"), F.coalesce("s1", F.lit("")).alias("before"), F.coalesce("s2", F.lit("")).alias("after"))


def transition_summary(moved: DataFrame) -> DataFrame:
    return moved.groupBy("before", "after").agg(F.count("*").alias("count"))


def review_series(shards: list[tuple[str, Shard]]) -> DataFrame:
    """(step, kind, name, added, removed, changed, same, delta) of each shard against the one before."""
    out = []
    for (_, a), (name, b) in zip(shards, shards[1:], strict=False):
        nodes, rels = a.changes(b)
        for kind, rows, group in (("node", nodes, "table"), ("rel", rels, "type")):
            out.append(change_summary(rows, group).withColumnRenamed(group, "name").select(F.lit(name).alias("step"), F.lit(kind).alias("kind"), "name", "added", "removed", "changed", "same", "delta"))
    return reduce(DataFrame.unionByName, out)


def review_matrix(shards: list[tuple[str, Shard]]) -> DataFrame:
    """(before, after, kind, name, …) for every ordered pair of shards."""
    out = []
    for i, (n1, a) in enumerate(shards):
        for n2, b in shards[i + 1 :]:
            out.append(review_series([(n1, a), (n2, b)]).withColumnRenamed("step", "after").select(F.lit(n1).alias("before"), "after", "kind", "name", "added", "removed", "changed", "same", "delta"))
    return reduce(DataFrame.unionByName, out)
