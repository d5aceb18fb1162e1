"""Lists, arrays, maps, structs and unions.

``list_*`` and ``array_*`` count from 1. Membership is null-safe. A map is a list of (key, value) entries, so
keys may repeat; a union is a struct of tag and value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import SCALARS, Context, alias, plain, register


def contains(l: Column, v: Column) -> Column:
    return F.exists(l, lambda x: x.eqNullSafe(v))


def position(l: Column, v: Column) -> Column:
    """First place of v from 1; 0 if absent; null list: null."""
    hits = F.filter(F.transform(l, lambda x, i: F.when(x.eqNullSafe(v), i + 1)), lambda x: x.isNotNull())
    return F.when(l.isNotNull(), F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(0)).cast("long"))


def element(l: Column, i: Column) -> Column:
    return F.try_element_at(l, F.when(i == 0, F.lit(1)).otherwise(i).cast("int"))


def part(l: Column, lo: Column, hi: Column | None = None) -> Column:
    """From lo to hi, both included, clamped to the list; negative counts from the end."""
    n = F.size(l)
    at = lambda x: F.when(x < 0, n + x + 1).otherwise(x)
    lo = F.greatest(at(lo), F.lit(1)).cast("int")
    hi = F.least(at(hi), n).cast("int") if hi is not None else n
    return F.slice(l, lo, F.greatest(hi - lo + 1, F.lit(0)).cast("int"))


def total(l: Column) -> Column:
    return F.aggregate(F.filter(l, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x.cast("double"))


def known(l: Column) -> Column:
    return F.size(F.filter(l, lambda x: x.isNotNull()))


def remove_first(l: Column, v: Column) -> Column:
    p = position(l, v)
    return F.when(p == 0, l).otherwise(F.concat(part(l, F.lit(1), F.when(p == 1, F.lit(0)).otherwise(p - 1)), F.slice(l, (p + 1).cast("int"), F.size(l))))


def has_all(l: Column, need: Column) -> Column:
    return F.forall(need, lambda v: contains(l, v))


def has_any(l: Column, some: Column) -> Column:
    return F.exists(some, lambda v: contains(l, v))


plain(
    list_creation=lambda *xs: F.array(*xs),
    list_element=element,
    list_len=lambda l: F.when(l.isNotNull(), F.size(l)).cast("long"),
    list_contains=contains, list_position=position, list_slice=part,
    list_slice_from=lambda l, lo: part(l, lo),
    list_concat=lambda a, b: F.concat(a, b),
    list_sort=lambda l: F.sort_array(l, True), list_reverse_sort=lambda l: F.sort_array(l, False),
    list_reverse=lambda l: F.reverse(l),
    list_has_all=has_all, list_has_any=has_any,
    list_union=lambda a, b: F.array_union(a, b), list_intersect=lambda a, b: F.array_intersect(a, b),
    list_except=lambda a, b: F.filter(a, lambda x: ~contains(b, x)),
    list_unique=lambda l: F.array_distinct(l),
    list_sum=total,
    list_avg=lambda l: F.when(known(l) > 0, total(l) / known(l)),
    list_min=lambda l: F.array_min(l).cast("double"), list_max=lambda l: F.array_max(l).cast("double"),
    list_product=lambda l: F.aggregate(F.filter(l, lambda x: x.isNotNull()), F.lit(1.0), lambda a, x: a * x.cast("double")),
    list_append=lambda l, x: F.array_append(l, x), list_prepend=lambda l, x: F.array_prepend(l, x),
    list_remove=remove_first, list_remove_all=lambda l, v: F.filter(l, lambda x: ~x.eqNullSafe(v)),
    list_flatten=lambda l: F.flatten(l),
    list_to_string=lambda l, d=None: F.concat_ws("", F.aggregate(F.transform(l, lambda x: F.coalesce(x.cast("string"), F.lit(""))), F.struct(F.lit("").alias("s"), F.lit(True).alias("first")), lambda a, x: F.struct(F.when(a["first"], x).otherwise(F.concat(a["s"], F.lit(",") if d is None else d, x)).alias("s"), F.lit(False).alias("first")))["s"]),
    list_any_value=lambda l: F.try_element_at(F.filter(l, lambda x: x.isNotNull()), F.lit(1)),
    array_sum=lambda l: F.when(F.size(l) > 0, total(l)), array_avg=lambda l: F.when(known(l) > 0, total(l) / known(l)),
    array_pop_front=lambda l: F.when(F.size(l) > 0, F.slice(l, 2, F.size(l))), array_pop_back=lambda l: F.when(F.size(l) > 0, F.slice(l, F.lit(1), F.size(l) - 1)),
    array_extract=lambda l, i: F.when(i >= 1, F.try_element_at(l, F.greatest(i, F.lit(1)).cast("int")).cast("double")),
    list_apply=lambda l: l,
)
alias(
    list_creation="array_value", list_element="list_extract", list_len="len cardinality array_length", list_contains="list_has array_contains array_has",
    list_position="list_indexof array_indexof array_position", list_slice="array_slice", list_concat="list_cat array_concat array_cat", list_sort="array_sort",
    list_reverse_sort="list_sort_desc", list_reverse="array_reverse", list_unique="list_distinct array_unique", list_min="array_min", list_max="array_max",
    list_append="array_append array_push_back", list_prepend="array_prepend array_push_front", list_to_string="array_to_string", list_apply="array_apply",
    array_extract="array_element",
)


@register("range", "generate_series")
def number_range(ctx: Context, lo: Column, hi: Column, step: Column | None = None) -> Column:
    """Both ends included; empty where the direction is wrong."""
    step = step if step is not None else F.lit(1)
    lo, hi, step = (x.cast("long") for x in (lo, hi, step))
    wrong = ((step > 0) & (lo > hi)) | ((step < 0) & (lo < hi))
    return F.when(wrong, F.array().cast("array<bigint>")).otherwise(F.sequence(lo, F.when(wrong, lo).otherwise(hi), F.when(wrong, F.lit(1).cast("long")).otherwise(step)))


@register("list_transform")
def list_transform(ctx: Context, l: Column, name: Column) -> Column:
    """With a function's name; the lambda form is an expression of its own."""
    f = SCALARS[str(ctx.literal(1)).lower()]
    return F.transform(l, lambda x: f(ctx, x))


# ---------------------------------------------------------------- maps, structs, unions
def entries(ctx: Context, m: Column) -> Column:
    return F.map_entries(m) if isinstance(ctx.type(m), T.MapType) else m


@register("map")
def make_map(ctx: Context, keys: Column, values: Column) -> Column:
    n = F.least(F.size(keys), F.size(values))
    return F.zip_with(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n), lambda k, v: F.struct(k.alias("key"), v.alias("value")))


@register("map_extract", "element_at")
def map_extract(ctx: Context, m: Column, k: Column) -> Column:
    """The values of a key, as a list; an element of a list by place."""
    t = ctx.type(m)
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, T.StructType):
        return element(m, k)
    return F.transform(F.filter(entries(ctx, m), lambda e: e["key"].eqNullSafe(k)), lambda e: e["value"])


for _names, _f in {
    ("map_keys",): lambda ctx, m: F.transform(entries(ctx, m), lambda e: e["key"]),
    ("map_values",): lambda ctx, m: F.transform(entries(ctx, m), lambda e: e["value"]),
    ("map_contains", "map_has_key"): lambda ctx, m, k: F.exists(entries(ctx, m), lambda e: e["key"].eqNullSafe(k)),
    ("map_size", "map_cardinality"): lambda ctx, m: F.size(entries(ctx, m)).cast("long"),
    ("map_entries",): lambda ctx, m: entries(ctx, m),
}.items():
    register(*_names)(_f)


@register("struct_pack")
def struct_pack(ctx: Context, *kv: Column) -> Column:
    """Alternating names (literals) and values."""
    return F.struct(*(v.alias(str(ctx.literal(2 * i))) for i, v in enumerate(kv[1::2])))


@register("struct_extract")
def struct_extract(ctx: Context, s: Column, name: Column) -> Column:
    return s.getField(str(ctx.literal(1)))


@register("keys")
def keys(ctx: Context, s: Column) -> Column:
    return F.array(*(F.lit(f.name) for f in ctx.type(s)))


@register("union_value")
def union_value(ctx: Context, v: Column, tag: Column | None = None) -> Column:
    return F.struct(F.lit(str(ctx.literal(1)) if tag is not None else "value").alias("tag"), v.alias("value"))


plain(union_tag=lambda u: u["tag"], union_extract=lambda u, k: F.when(u["tag"] == k, u["value"]))
