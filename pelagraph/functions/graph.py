"""Functions on nodes, relationships, paths and internal ids.

A node value is a struct with ``_id`` (text ``label:key``), ``_label`` and its properties; a relationship has
``_type``, ``_src`` and ``_dst`` (texts like ``_id``); a path has ``nodes`` (ids) and ``rels``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import Context, plain, register


@register("length")
def length(ctx: Context, x: Column) -> Column:
    """Relationships of a path; elements of a list; characters of a text."""
    t = ctx.type(x)
    if isinstance(t, T.StructType) and "rels" in t.names:
        return F.size(x["rels"]).cast("long")
    return F.when(x.isNotNull(), F.size(x)).cast("long") if isinstance(t, (T.ArrayType, T.MapType)) else F.length(x.cast("string")).cast("long")


@register("properties")
def properties(ctx: Context, x: Column) -> Column:
    return F.struct(*(x[f.name].alias(f.name) for f in ctx.type(x) if not f.name.startswith("_")))


@register("id")
def node_id(ctx: Context, x: Column) -> Column:
    t = ctx.type(x)
    return x["_id"] if isinstance(t, T.StructType) else x.cast("string")


@register("internal_id")
def internal_id(ctx: Context, table: Column, offset: Column | None = None) -> Column:
    """Builds ``table:offset``, or reads its parts."""
    if offset is not None:
        return F.concat(table.cast("string"), F.lit(":"), offset.cast("string"))
    return F.struct(F.split_part(table, F.lit(":"), F.lit(1)).alias("table"), F.split_part(table, F.lit(":"), F.lit(2)).alias("offset"))


def _part(i: int):
    def f(ctx: Context, x: Column) -> Column:
        return F.split_part(node_id(ctx, x), F.lit(":"), F.lit(i))

    return f


for _n in ("tableid", "table_id"):
    register(_n)(_part(1))
for _n in ("offset", "offsetid", "offset_id", "nodeoffset", "node_offset"):
    register(_n)(_part(2))


@register("cost")
def cost(ctx: Context, rel: Column, name: Column | None = None) -> Column:
    return rel.getField(str(ctx.literal(1)) if name is not None else "cost").cast("double")


plain(
    nodes=lambda p: p["nodes"], rels=lambda p: p["rels"], relationships=lambda p: p["rels"],
    is_trail=lambda p: F.size(F.array_distinct(p["rels"])) == F.size(p["rels"]), is_acyclic=lambda p: F.size(F.array_distinct(p["nodes"])) == F.size(p["nodes"]),
    label=lambda n: n["_label"], labels=lambda n: n["_label"], type=lambda r: r["_type"], relationship_type=lambda r: r["_type"],
    start_node=lambda r: r["_src"], startnode=lambda r: r["_src"], end_node=lambda r: r["_dst"], endnode=lambda r: r["_dst"],
    internal_id_equal=lambda a, b: a.eqNullSafe(b),
)
