"""JSON functions on texts; null where the text is no JSON. Paths are split at ``. $ [ ]``, arrays from 0."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import Context, plain, register


def _load(s: str | None) -> tuple[bool, Any]:
    if s is None:
        return False, None
    try:
        return True, json.loads(s)
    except ValueError:
        return False, None


def _dump(v: Any) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def holds(whole: Any, piece: Any) -> bool:
    """Whether piece is contained: objects by key, arrays by element, anything else by equality."""
    if isinstance(whole, dict) and isinstance(piece, dict):
        return all(k in whole and holds(whole[k], v) for k, v in piece.items())
    if isinstance(whole, list) and isinstance(piece, list):
        return all(any(holds(x, y) for x in whole) for y in piece)
    return type(whole) is type(piece) and whole == piece


def merge_patch(target: Any, patch: Any) -> Any:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def structure(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: structure(x) for k, x in v.items()}
    if isinstance(v, list):
        return [structure(v[0])] if v else []
    return "NULL" if v is None else "BOOLEAN" if isinstance(v, bool) else "UBIGINT" if isinstance(v, int) and v >= 0 else "BIGINT" if isinstance(v, int) else "DOUBLE" if isinstance(v, float) else "VARCHAR"


@F.pandas_udf(T.BooleanType())
def _contains(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        (ok, v), (ok2, w) = _load(x), _load(y)
        return ok and ok2 and holds(v, w)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _merge(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        (ok, v), (ok2, w) = _load(x), _load(y)
        return _dump(merge_patch(v, w)) if ok and ok2 else None

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _structure(a: pd.Series) -> pd.Series:
    return pd.Series([_dump(structure(v)) if ok else None for ok, v in map(_load, a)], dtype=object)


@F.pandas_udf(T.StringType())
def _normal(a: pd.Series) -> pd.Series:
    return pd.Series([_dump(v) if ok else None for ok, v in map(_load, a)], dtype=object)


def _path(p: str) -> str:
    return "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in re.split(r"[.$\[\]]+", p) if x)


@register("json_extract")
def json_extract(ctx: Context, j: Column, p: Column) -> Column:
    return F.get_json_object(j, _path(str(ctx.literal(1))))


@register("json_type")
def json_type(ctx: Context, j: Column) -> Column:
    v = F.try_parse_json(j)
    kind = F.schema_of_variant(v)
    return F.when(v.isNotNull(), F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "VARCHAR").when(kind == "BIGINT", F.when(F.startswith(F.trim(j), F.lit("-")), "BIGINT").otherwise("UBIGINT")).when(kind == "BOOLEAN", "BOOLEAN").when(kind == "VOID", "NULL").otherwise("DOUBLE"))


@register("to_json", "cast_to_json", "row_to_json", "array_to_json", "json_quote")
def to_json(ctx: Context, x: Column) -> Column:
    t = ctx.type(x)
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(x)
    inner = F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    return F.substr(inner, F.lit(6), F.length(inner) - 6)


@register("json_array")
def json_array(ctx: Context, *xs: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(to_json(ctx, x) for x in xs)), F.lit("]"))


@register("json_object")
def json_object(ctx: Context, *kv: Column) -> Column:
    items = [F.concat(to_json(ctx, k.cast("string")), F.lit(":"), to_json(ctx, v)) for k, v in zip(kv[::2], kv[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


plain(
    json_valid=lambda j: F.when(j.isNotNull(), F.try_parse_json(j).isNotNull()), json_array_length=lambda j: F.json_array_length(j).cast("long"),
    json_keys=lambda j: F.json_object_keys(j), json_contains=lambda a, b: _contains(a, b), json_merge_patch=lambda a, b: _merge(a, b),
    json_structure=lambda a: _structure(a), json=lambda a: _normal(a),
)
