"""Conditionals, hashes, random values, information, sequences and CSV helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import SCALARS, Context, alias, plain, register
from pelagraph.functions.texts import text

VERSION = "0.1"

plain(
    coalesce=lambda *xs: F.coalesce(*xs), ifnull=lambda a, b: F.coalesce(a, b), nvl2=lambda a, b, c: F.nvl2(a, b, c),
    nullif=lambda a, b: F.when(~a.eqNullSafe(b), a),
    **{"if": lambda p, a, b: F.when(p, a).otherwise(b)},
    equal_null=lambda a, b: a.eqNullSafe(b),
    random=lambda: F.rand(), random_int=lambda n: F.floor(F.rand() * n).cast("long"),
    hash=lambda *xs: F.xxhash64(*xs),
    md5=lambda x: F.md5(text(x).cast("binary")), sha256=lambda x: F.sha2(text(x).cast("binary"), 256), sha1=lambda x: F.sha1(text(x).cast("binary")),
    crc32=lambda x: F.crc32(text(x).cast("binary")).cast("long"),
    version=lambda: F.lit(VERSION), db_version=lambda: F.lit(VERSION), gds_version=lambda: F.lit(VERSION), catalog_version=lambda: F.lit(1).cast("long"),
    error=lambda m: F.raise_error(m),
    sleep=lambda ms: ms,
    bool_and=lambda a, b: F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False)), bool_or=lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
    bool_xor=lambda a, b: F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False)),
    greatest=lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0], least=lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0],
    constant_or_null=lambda a, b: F.when(b.isNotNull(), a),
    csv_escape=lambda s: F.replace(text(s), F.lit('"'), F.lit('""')), csv_quote=lambda s: F.concat(F.lit('"'), F.replace(text(s), F.lit('"'), F.lit('""')), F.lit('"')),
    csv_header=lambda *xs: F.concat_ws(",", *xs),
    copy_to_csv=lambda p, *_: p, copy_to_parquet=lambda p, *_: p, copy_to_json=lambda p, *_: p, export_csv=lambda p, *_: p, export_parquet=lambda p, *_: p,
    storage_info=lambda *_: F.lit("parquet"),
)
alias(ifnull="nvl", random="rand", **{"if": "iff"})


@register("format_csv_row", "write_csv_line")
def csv_row(ctx: Context, *xs: Column) -> Column:
    """The fields of one line, quoted where needed."""
    quote = lambda s: F.when(F.rlike(s, F.lit('[",\\r\\n]')), SCALARS["csv_quote"](ctx, s)).otherwise(s)
    return F.concat_ws(",", *(quote(F.lower(text(x)) if isinstance(ctx.type(x), T.BooleanType) else text(x)) for x in xs))


# ---------------------------------------------------------------- session state
@register("current_setting")
def current_setting(ctx: Context, name: Column) -> Column:
    return F.lit(ctx.session.settings.get(str(ctx.literal(0)), ctx.session.spark.conf.get(str(ctx.literal(0)), None)))


@register("set_setting")
def set_setting(ctx: Context, name: Column, value: Column) -> Column:
    ctx.session.settings[str(ctx.literal(0))] = ctx.literal(1)
    return value


@register("show_tables_count")
def show_tables_count(ctx: Context) -> Column:
    return F.lit(len(ctx.session.catalog.nodes) + len(ctx.session.catalog.rels)).cast("long")


@register("table_type")
def table_type(ctx: Context, name: Column) -> Column:
    n = str(ctx.literal(0))
    return F.lit("NODE" if n in ctx.session.catalog.nodes else "REL" if n in ctx.session.catalog.rels else None)


@register("show_tables")
def show_tables(ctx: Context) -> Column:
    return F.array(*(F.lit(n) for n in sorted({*ctx.session.catalog.nodes, *ctx.session.catalog.rels})))


@register("show_functions_contains")
def show_functions_contains(ctx: Context, name: Column) -> Column:
    return F.lit(str(ctx.literal(0)).lower() in SCALARS)


@register("file_info")
def file_info(ctx: Context, path: Column) -> Column:
    """Size and kind of a path, by the cluster's file system."""
    jvm, jsc = ctx.session.spark._jvm, ctx.session.spark._jsc
    p = jvm.org.apache.hadoop.fs.Path(str(ctx.literal(0)))
    fs = p.getFileSystem(jsc.hadoopConfiguration())
    there = fs.exists(p)
    return F.struct(F.lit(there).alias("exists"), F.lit(fs.getContentSummary(p).getLength() if there else None).cast("long").alias("size"))


@register("nextval")
def nextval(ctx: Context, name: Column) -> Column:
    """One value a call of the query, from a counter of the session."""
    n = str(ctx.literal(0))
    ctx.session.sequences[n] = ctx.session.sequences.get(n, 0) + 1
    return F.lit(ctx.session.sequences[n]).cast("long")


@register("currval")
def currval(ctx: Context, name: Column) -> Column:
    return F.lit(ctx.session.sequences.get(str(ctx.literal(0)))).cast("long")


@register("setval")
def setval(ctx: Context, name: Column, value: Column) -> Column:
    ctx.session.sequences[str(ctx.literal(0))] = int(ctx.literal(1))
    return value
