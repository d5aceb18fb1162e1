"""Arithmetic and mathematics. ``log`` is base 10, ``round`` is half-even, integer division truncates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import Context, alias, plain, register

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _is_interval(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["months", "days", "micros"]


def shift(ctx: Context, a: Column, b: Column, sign: int) -> Column:
    """A date or timestamp plus (minus) an interval struct."""
    step = F.make_interval(F.lit(0), b["months"] * sign, F.lit(0), b["days"] * sign, F.lit(0), F.lit(0), (b["micros"] * sign / F.lit(1_000_000)).cast("decimal(18,6)"))
    return a.cast("timestamp") + step


@register("+")
def add(ctx: Context, a: Column, b: Column) -> Column:
    x, y = ctx.type(a), ctx.type(b)
    if _is_interval(x) and _is_interval(y):
        return F.struct(*((a[f] + b[f]).alias(f) for f in ("months", "days", "micros")))
    if isinstance(x, _DATES) and _is_interval(y):
        return shift(ctx, a, b, 1)
    if isinstance(y, _DATES) and _is_interval(x):
        return shift(ctx, b, a, 1)
    if isinstance(x, T.DateType) or isinstance(y, T.DateType):
        return F.date_add(a, b.cast("int")) if isinstance(x, T.DateType) else F.date_add(b, a.cast("int"))
    if isinstance(x, T.ArrayType) or isinstance(y, T.ArrayType):
        return F.concat(a if isinstance(x, T.ArrayType) else F.array(a), b if isinstance(y, T.ArrayType) else F.array(b))
    if isinstance(x, T.StringType) or isinstance(y, T.StringType):
        return F.concat(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit("")))
    return a + b


@register("-")
def subtract(ctx: Context, a: Column, b: Column) -> Column:
    x, y = ctx.type(a), ctx.type(b)
    if _is_interval(x) and _is_interval(y):
        return F.struct(*((a[f] - b[f]).alias(f) for f in ("months", "days", "micros")))
    if isinstance(x, _DATES) and _is_interval(y):
        return shift(ctx, a, b, -1)
    if isinstance(x, T.DateType) and isinstance(y, T.DateType):
        return F.struct(F.lit(0).alias("months"), F.datediff(a, b).alias("days"), F.lit(0).cast("long").alias("micros"))
    if isinstance(x, T.DateType):
        return F.date_sub(a, b.cast("int"))
    return a - b


@register("/")
def divide(ctx: Context, a: Column, b: Column) -> Column:
    if isinstance(ctx.type(a), T.IntegralType) and isinstance(ctx.type(b), T.IntegralType):
        return F.call_function("div", a, b)
    return F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


@F.pandas_udf(T.DoubleType())
def _gamma(x: pd.Series) -> pd.Series:
    def one(v: float) -> float:
        try:
            return math.gamma(v)
        except (ValueError, OverflowError):
            return float("nan")

    return x.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    def one(v: float) -> float:
        try:
            return math.lgamma(v) if math.gamma(v) > 0 else float("nan")
        except OverflowError:
            return math.lgamma(v)
        except ValueError:
            return float("nan")

    return x.map(one, na_action="ignore")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, unrolled by aggregate over the most steps that 64-bit numbers need."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["x"]


plain(**{
    "*": lambda a, b: a * b,
    "%": lambda a, b: F.try_mod(a, b),
    "^": lambda a, b: F.pow(a, b),
    "abs": F.abs,
    "ceil": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "sign": lambda x: F.signum(x).cast("long"),
    "even": lambda x: 2 * F.floor(x / 2),
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp,
    "square": lambda x: x * x,
    "log": F.log10, "log2": F.log2, "log10": F.log10, "ln": F.ln,
    "pi": lambda: F.pi(), "e": lambda: F.e(),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "cot": F.cot,
    "degrees": F.degrees, "radians": F.radians,
    "isinf": lambda x: F.abs(x.cast("double")) == F.lit(float("inf")),
    "isnan": lambda x: F.isnan(x.cast("double")),
    "isfinite": lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    "infinity": lambda: F.lit(float("inf")), "nan": lambda: F.lit(float("nan")),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "bitshift_left": lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")),
    "bitshift_right": lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")),
    "~": lambda x: F.bitwise_not(x),
    "negate": lambda x: F.negative(x),
    "factorial": lambda n: F.when((n < 0) | (n > 20), F.raise_error(F.lit("factorial is defined for 0 to 20"))).otherwise(F.factorial(n.cast("int"))),
    "gcd": gcd,
    "lcm": lambda a, b: F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a.cast("long"), gcd(a, b)) * b.cast("long"))),
    "hypot": lambda a, b: F.hypot(a, b),
    "bit_count": lambda x: F.bit_count(x).cast("long"),
    "gamma": lambda x: _gamma(x.cast("double")), "lgamma": lambda x: _lgamma(x.cast("double")),
    "setseed": lambda x: F.lit(None).cast("double"),
})
alias(**{"%": "mod", "^": "pow power", "ceil": "ceiling", "bitwise_and": "&", "bitwise_or": "|", "bitwise_xor": "xor", "bitshift_left": "<<", "bitshift_right": ">>"})


@register("round")
def round_(ctx: Context, x: Column, n: Column | None = None) -> Column:
    return F.bround(x, int(ctx.literal(1)) if n is not None else 0)
