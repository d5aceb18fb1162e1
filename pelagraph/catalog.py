"""Node and relationship tables by name. Tables are DataFrames; every change makes new ones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagraph.plans.parser import Expr, QueryError
from pelagraph.storage import cut

#: Prefix of a node's properties in a relationship's wide table.
NODE = "__node__"


@dataclass(frozen=True)
class NodeTable:
    label: str
    df: DataFrame
    key: str

    @property
    def properties(self) -> list[str]:
        return self.df.columns


@dataclass(frozen=True)
class RelPair:
    """One FROM/TO pair of a relationship table: rows with _src and _dst (the nodes' keys) and properties.

    Once one of its relationships is to be changed, also _rid, which names a row.

    If the rows are an end's node table themselves (its foreign key is the relationship), end is that end's column, and
    wide is df with the node's properties as well, so that the node needs no join.
    """

    source: str
    target: str
    df: DataFrame
    end: str | None = None
    wide: DataFrame | None = None

    @property
    def properties(self) -> list[str]:
        return [x for x in self.df.columns if x not in ("_src", "_dst", "_rid")]


@dataclass(frozen=True)
class RelTable:
    name: str
    pairs: tuple[RelPair, ...]

    @property
    def properties(self) -> list[str]:
        return list(dict.fromkeys(p for x in self.pairs for p in x.properties))


@dataclass
class Macro:
    name: str
    parameters: list[tuple[str, Expr | None]]
    body: Expr


@dataclass
class Catalog:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: dict[str, RelTable] = field(default_factory=dict)
    macros: dict[str, Macro] = field(default_factory=dict)

    def snapshot(self) -> Catalog:
        return Catalog(dict(self.nodes), dict(self.rels), dict(self.macros))

    def add_node(self, label: str, df: DataFrame, key: str) -> None:
        if label in self.rels or label in self.nodes:
            raise QueryError(f"table {label} exists already")
        if key not in df.columns:
            raise QueryError(f"{label} has no column {key} for its key")
        self.nodes[label] = NodeTable(label, df, key)

    def add_rel(self, name: str, source: str, target: str, df: DataFrame, src: str, dst: str, properties: list[str] | None = None) -> None:
        """Adds the pair to the relationship table, which it makes if need be."""
        for label in (source, target):
            self.node(label)
        rest = [x for x in df.columns if x not in (src, dst)] if properties is None else properties
        shaped = df.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), *rest)
        known = self.rels.get(name, RelTable(name, ()))
        pair = RelPair(source, target, shaped)
        for label, column, end in ((source, src, "_src"), (target, dst, "_dst")):
            node = self.node(label)
            if df is node.df and column == node.key:
                same = [F.col(f"`{x}`").alias(f"{NODE}{x}") for x in node.properties]
                pair = replace(pair, end=end, wide=df.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), *rest, *same))
        self.rels[name] = replace(known, pairs=(*known.pairs, pair))

    def node(self, label: str) -> NodeTable:
        if label not in self.nodes:
            raise QueryError(f"no node table {label}")
        return self.nodes[label]

    def rel(self, name: str) -> RelTable:
        if name not in self.rels:
            raise QueryError(f"no relationship table {name}")
        return self.rels[name]

    def identify(self, name: str) -> None:
        """Give the relationship table's rows ids; it is written, so that they stay."""
        for i, pair in enumerate(self.rel(name).pairs):
            if "_rid" not in pair.df.columns:
                self.replace_pair(name, i, cut(pair.df.withColumn("_rid", F.expr("uuid()")), "identified"))

    def replace_node(self, label: str, df: DataFrame) -> None:
        self.nodes[label] = replace(self.node(label), df=df)
        for name, t in list(self.rels.items()):  # their rows are this node table no longer
            if any(p.end and label in (p.source, p.target) for p in t.pairs):
                self.rels[name] = replace(t, pairs=tuple(replace(p, end=None, wide=None) if label in (p.source, p.target) else p for p in t.pairs))

    def replace_pair(self, name: str, i: int, df: DataFrame) -> None:
        t = self.rel(name)
        pairs = list(t.pairs)
        pairs[i] = replace(pairs[i], df=df, end=None, wide=None)
        self.rels[name] = replace(t, pairs=tuple(pairs))
