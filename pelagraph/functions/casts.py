"""Casts; what cannot be cast is null. Integers from text with a fraction, or from doubles, are truncated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import Context, plain, register

#: Dialect type -> Spark type. There are no unsigned types, so each takes the next wider one.
TYPES = {
    "bool": "boolean", "boolean": "boolean",
    "int8": "tinyint", "tinyint": "tinyint", "int16": "smallint", "smallint": "smallint", "int32": "int", "int": "bigint", "integer": "int", "int64": "bigint", "bigint": "bigint", "serial": "bigint",
    "uint8": "smallint", "utinyint": "smallint", "uint16": "int", "usmallint": "int", "uint32": "bigint", "uinteger": "bigint", "uint64": "decimal(20,0)", "ubigint": "decimal(20,0)",
    "int128": "decimal(38,0)", "hugeint": "decimal(38,0)", "uint128": "decimal(38,0)",
    "double": "double", "float": "double", "real": "double", "decimal": "double", "float32": "float", "real32": "float",
    "string": "string", "varchar": "string", "text": "string", "uuid": "string",
    "date": "date", "timestamp": "timestamp", "datetime": "timestamp", "blob": "binary", "bytea": "binary", "json": "string",
}
_WHOLE = {"tinyint", "smallint", "int", "bigint", "decimal(20,0)", "decimal(38,0)"}


def spark_type(name: str) -> str:
    """INT64[], STRUCT and DECIMAL(p, s) included."""
    n = name.strip().lower()
    if n.endswith("]"):
        return f"array<{spark_type(n[: n.rindex('[')])}>"
    if n.startswith("decimal("):
        return n.replace(" ", "")
    if n not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[n]


def cast(ctx: Context, x: Column, to: str) -> Column:
    target, t = spark_type(to), ctx.type(x)
    if target in _WHOLE and isinstance(t, (T.StringType, T.DoubleType, T.FloatType, T.DecimalType)):
        wide = x.try_cast("decimal(38,6)") if isinstance(t, T.StringType) else x
        out = F.when(wide >= 0, F.floor(wide)).otherwise(F.ceil(wide))
        return out.try_cast(target)
    if to.lower() == "uuid":
        return F.when(F.rlike(x, F.lit("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), F.lower(x))
    if target == "boolean":
        return to_bool(ctx, x)
    if target == "date" and isinstance(t, T.StringType):
        return F.try_to_timestamp(x).cast("date")
    if target == "timestamp" and isinstance(t, T.StringType):
        return F.try_to_timestamp(x)
    if target == "string":
        return to_text(ctx, x)
    if target == "binary":
        return to_blob(x)
    return x.try_cast(target)


def to_bool(ctx: Context, x: Column) -> Column:
    """A text is true unless it is '', 'false' or '0'; a number unless it is 0."""
    t = ctx.type(x)
    if isinstance(t, T.StringType):
        return F.when(x.isNotNull(), ~F.lower(x).isin("", "false", "0"))
    return x.cast("boolean") if isinstance(t, T.BooleanType) else x != 0


def to_text(ctx: Context, x: Column) -> Column:
    return F.to_json(x) if isinstance(ctx.type(x), (T.ArrayType, T.StructType, T.MapType)) else x.cast("string")


def to_blob(x: Column) -> Column:
    """Even-length hexadecimal digits are bytes; any other text is its UTF-8."""
    return F.when(F.rlike(x.cast("string"), F.lit("^([0-9A-Fa-f]{2})+$")), F.unhex(x.cast("string"))).otherwise(F.encode(x.cast("string"), "utf-8"))


def _to(to: str):
    return lambda ctx, x: cast(ctx, x, to)


for _to_name, _names in {
    "int64": "tointeger toint int to_int to_int64 int64 bigint to_serial", "int32": "to_int32 int32 integer", "int16": "to_int16 int16 smallint", "int8": "to_int8 int8 tinyint",
    "uint64": "to_uint64 uint64 ubigint", "uint32": "to_uint32 uint32 uinteger", "uint16": "to_uint16 uint16 usmallint", "uint8": "to_uint8 uint8 utinyint",
    "double": "tofloat to_float float real tododuble todouble to_double double decimal", "float32": "to_float32 float32 real32",
    "bool": "tobool to_bool boolean bool", "string": "tostring to_string str string varchar", "int128": "to_int128", "uuid": "to_uuid string_to_uuid",
}.items():
    for _n in _names.split():
        register(_n)(_to(_to_name))

plain(blob=to_blob, to_blob=to_blob, uuid_to_string=lambda x: x.cast("string"), uuid_version=lambda x: F.substring(x, 15, 1).try_cast("bigint"), gen_random_uuid=lambda: F.uuid(), uuid=lambda: F.uuid())


@register("to_uint128")
def to_uint128(ctx: Context, x: Column) -> Column:
    v = cast(ctx, x, "int128")
    return F.when(v >= 0, v)


@register("cast", "try_cast")
def cast_function(ctx: Context, x: Column, to: Column) -> Column:
    return cast(ctx, x, str(ctx.literal(1)))


_NAMES = {"bigint": "INT64", "int": "INT32", "smallint": "INT16", "tinyint": "INT8", "double": "DOUBLE", "float": "FLOAT", "string": "STRING", "boolean": "BOOL", "date": "DATE", "timestamp": "TIMESTAMP", "binary": "BLOB", "void": "ANY"}


@register("typeof", "pg_typeof")
def typeof(ctx: Context, x: Column) -> Column:
    t = ctx.type(x)
    name = "LIST" if isinstance(t, T.ArrayType) else "STRUCT" if isinstance(t, T.StructType) else "MAP" if isinstance(t, T.MapType) else _NAMES.get(t.simpleString(), t.simpleString().upper())
    return F.lit(name)
