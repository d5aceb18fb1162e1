"""Text functions. ``substring`` counts from 0 (negative: from the end); ``position`` and ``split_part`` from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import Context, alias, plain, register

_BLANK = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def literal_pattern(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def substring(s: Column, start: Column, n: Column | None = None) -> Column:
    at = F.when(start < 0, F.greatest(F.length(s) + start, F.lit(0))).otherwise(start).cast("int") + 1
    return F.substr(s, at, n.cast("int")) if n is not None else F.substr(s, at)


def split_part(s: Column, d: Column, n: Column) -> Column:
    parts = F.split(s, literal_pattern(d))
    return F.when(n > 0, F.coalesce(F.try_element_at(parts, F.greatest(n, F.lit(1)).cast("int")), F.lit("")))


plain(
    starts_with=lambda s, p: F.startswith(s, p), ends_with=lambda s, p: F.endswith(s, p), contains=lambda s, p: F.contains(s, p),
    regexp_matches=lambda s, p: F.rlike(s, p),
    regexp_full_match=lambda s, p: F.rlike(s, F.concat(F.lit("^(?:"), p, F.lit(")$"))),
    tolower=F.lower, toupper=F.upper,
    trim=lambda s: F.regexp_replace(s, f"^{_BLANK}|{_BLANK}$", ""), ltrim=lambda s: F.regexp_replace(s, f"^{_BLANK}", ""), rtrim=lambda s: F.regexp_replace(s, f"{_BLANK}$", ""),
    repeat=lambda s, n: F.when(n <= 0, s).otherwise(F.repeat(s, n.cast("int"))),
    concat=lambda a, b: F.concat(text(a), text(b)),
    concat_ws=lambda d, *xs: F.concat(F.lit(""), *(y for i, x in enumerate(xs) for y in ((d, text(x)) if i else (text(x),)))),
    lpad=lambda s, n, p=None: F.lpad(s, n.cast("int"), F.lit(" ") if p is None else p), rpad=lambda s, n, p=None: F.rpad(s, n.cast("int"), F.lit(" ") if p is None else p),
    substring=substring,
    left=lambda s, n: F.left(s, n.cast("int")), right=lambda s, n: F.right(s, n.cast("int")),
    replace=lambda s, a, b: F.replace(s, a, b),
    regexp_replace=lambda s, p, r: F.regexp_replace(s, p, r),
    regexp_extract=lambda s, p, g=None: F.nullif(F.call_function("regexp_extract", s, p, F.lit(0) if g is None else g.cast("int")), F.lit("")),
    regexp_extract_all=lambda s, p, g=None: F.regexp_extract_all(s, p, F.lit(0) if g is None else g.cast("int")),
    regexp_split_to_array=lambda s, p: F.split(s, p),
    split=lambda s, d: F.split(s, literal_pattern(d)),
    split_part=split_part,
    position=lambda s, p: F.call_function("instr", s, p).cast("long"),
    ascii=lambda s: F.ascii(s).cast("long"), chr=lambda n: F.call_function("char", n),
    levenshtein=lambda a, b: F.levenshtein(a, b).cast("long"),
    string_agg=lambda *xs: F.concat(F.lit(""), *(y for i, x in enumerate(xs) for y in ((xs[-1], text(x)) if i else (text(x),)))),
    initcap=F.initcap,
    base64_encode=lambda s: F.base64(F.encode(s, "utf-8")), base64_decode=lambda s: F.decode(F.try_to_binary(s, F.lit("base64")), "utf-8"),
    url_encode=lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), url_decode=lambda s: F.try_url_decode(s),
    to_hex=lambda n: F.lower(F.hex(n)), from_hex=lambda s: F.conv(s, 16, 10).cast("long"),
    bit_length=lambda s: F.bit_length(s).cast("long"),
    octet_length=lambda s: F.octet_length(s).cast("long"), encode=lambda s: F.encode(s, "utf-8"), decode=lambda b: F.decode(b, "utf-8"),
)
alias(
    starts_with="startswith prefix", ends_with="endswith suffix", regexp_matches="regexp_like", tolower="lower lcase", toupper="upper ucase", trim="strip",
    substring="substr", split="string_split str_split string_to_array", position="locate instr", ascii="unicode", levenshtein="editdistance",
)


@register("||")
def join_texts(ctx: Context, a: Column, b: Column) -> Column:
    if isinstance(ctx.type(a), T.ArrayType):
        return F.concat(a, b)
    return F.concat(text(a), text(b))


@register("reverse")
def reverse(ctx: Context, x: Column) -> Column:
    return F.reverse(x)


@register("size", "strlen", "char_length", "character_length")
def size(ctx: Context, x: Column) -> Column:
    """Length of a text; of a list its number of elements (not of its text form)."""
    t = ctx.type(x)
    return F.when(x.isNotNull(), F.size(x)).cast("long") if isinstance(t, (T.ArrayType, T.MapType)) else F.length(x.cast("string")).cast("long")


@register("printf", "format", "format_string")
def printf(ctx: Context, form: Column, *xs: Column) -> Column:
    return F.format_string(str(ctx.literal(0)).replace("%i", "%d"), *xs)
