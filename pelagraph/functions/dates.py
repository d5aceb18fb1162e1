"""Dates, timestamps and intervals.

Texts are read as dates or timestamps; what cannot be read is null. ``dayofweek`` is 0 on Sunday;
``date_diff(part, a, b)`` is b - a, ``timestamp_diff(part, a, b)`` is a - b. An interval is a struct of months,
days and micros. Formats are .NET patterns, translated to Java's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions.registry import Context, alias, plain, register


def stamp(ctx: Context, x: Column) -> Column:
    t = ctx.type(x)
    if isinstance(t, T.StringType):
        return F.try_to_timestamp(x)
    if isinstance(t, T.NumericType):
        return F.timestamp_seconds(x)
    return x.cast("timestamp")


def day(ctx: Context, x: Column) -> Column:
    return F.try_to_timestamp(x).cast("date") if ctx.is_text(x) else x.cast("date")


_PARTS = {
    "year": lambda t: F.year(t), "month": lambda t: F.month(t), "day": lambda t: F.dayofmonth(t),
    "hour": lambda t: F.hour(t), "minute": lambda t: F.minute(t), "second": lambda t: F.second(t),
    "millisecond": lambda t: F.date_format(t, "SSS"), "microsecond": lambda t: F.pmod(F.unix_micros(t), F.lit(1_000_000)),
    "quarter": lambda t: F.quarter(t), "week": lambda t: F.weekofyear(t),
    "dayofweek": lambda t: F.dayofweek(t) - 1, "dayofyear": lambda t: F.dayofyear(t),
    "epoch": lambda t: F.unix_seconds(t), "century": lambda t: F.floor((F.year(t) - 1) / 100) + 1,
}
_SHORT = {"years": "year", "yy": "year", "months": "month", "mm": "month", "days": "day", "dd": "day", "hours": "hour", "hh": "hour", "minutes": "minute", "mi": "minute", "seconds": "second", "ss": "second", "milliseconds": "millisecond", "ms": "millisecond", "microseconds": "microsecond", "us": "microsecond", "quarters": "quarter", "weeks": "week", "dow": "dayofweek", "doy": "dayofyear"}


def unit(ctx: Context, i: int) -> str:
    u = str(ctx.literal(i)).lower()
    return _SHORT.get(u, u)


def _is_interval(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["months", "days", "micros"]


def _part(name: str):
    def f(ctx: Context, x: Column) -> Column:
        if _is_interval(ctx.type(x)):
            of = {"year": F.floor(x["months"] / 12), "month": x["months"] % 12, "day": x["days"], "hour": F.floor(x["micros"] / 3_600_000_000), "minute": F.floor(x["micros"] / 60_000_000) % 60, "second": F.floor(x["micros"] / 1_000_000) % 60}
            return of[name].cast("long")
        return _PARTS[name](stamp(ctx, x)).cast("long")

    return f


for _n in _PARTS:
    register(_n)(_part(_n))
for _n in ("year", "month", "day", "hour", "minute", "second", "millisecond"):
    register(f"timestamp_{_n}")(_part(_n))


@register("date_part", "extract", "datepart")
def date_part(ctx: Context, part: Column, x: Column) -> Column:
    return _part(unit(ctx, 0))(ctx, x)


@register("date_trunc", "datetrunc")
def date_trunc(ctx: Context, part: Column, x: Column) -> Column:
    return F.date_trunc(unit(ctx, 0), stamp(ctx, x))


def _shifted(ctx: Context, u: str, t: Column, n: Column) -> Column:
    micros = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}
    if u in ("year", "quarter", "month"):
        return t + F.make_interval(F.lit(0), (n * {"year": 12, "quarter": 3, "month": 1}[u]).cast("int"))
    if u in ("day", "week"):
        return t + F.make_interval(F.lit(0), F.lit(0), F.lit(0), (n * (7 if u == "week" else 1)).cast("int"))
    return F.timestamp_micros(F.unix_micros(t) + n.cast("long") * micros.get(u, 86_400_000_000))


@register("date_add")
def date_add(ctx: Context, part: Column, x: Column, n: Column) -> Column:
    return _shifted(ctx, unit(ctx, 0), stamp(ctx, x), n)


@register("date_sub")
def date_sub(ctx: Context, part: Column, x: Column, n: Column) -> Column:
    return _shifted(ctx, unit(ctx, 0), stamp(ctx, x), -n)


@register("timestamp_add")
def timestamp_add(ctx: Context, part: Column, n: Column, x: Column) -> Column:
    return _shifted(ctx, unit(ctx, 0), stamp(ctx, x), n)


@register("date_diff", "datediff")
def date_diff(ctx: Context, part: Column, a: Column, b: Column) -> Column:
    u, x, y = unit(ctx, 0), stamp(ctx, a), stamp(ctx, b)
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    if u in ("year", "month", "quarter"):
        return {"year": F.year(y) - F.year(x), "month": months, "quarter": F.floor(months / 3)}[u].cast("long")
    size = {"week": 604_800, "day": 86_400, "hour": 3600, "minute": 60, "second": 1}.get(u)
    micros = F.unix_micros(y) - F.unix_micros(x)
    return F.call_function("div", micros, F.lit(size * 1_000_000 if size else 1000 if u == "millisecond" else 1))


@register("timestamp_diff")
def timestamp_diff(ctx: Context, part: Column, a: Column, b: Column) -> Column:
    days = {"year": 365.25, "month": 30.44, "week": 7, "day": 1, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400, "millisecond": 1 / 86_400_000}.get(unit(ctx, 0), 1)
    micros = (F.unix_micros(stamp(ctx, a)) - F.unix_micros(stamp(ctx, b))).cast("double")
    return F.floor(F.abs(micros) / F.lit(round(days * 86_400_000_000))).cast("long") * F.signum(micros).cast("long")


def java_pattern(net: str) -> str:
    """.NET date pattern -> Java date pattern, for the letters that differ; %-patterns of strftime as well."""
    percent = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "y": "yy", "f": "SSSSSS"}
    if "%" in net:
        return re.sub(r"%(\w)|([^%]+)", lambda m: percent.get(m[1], "") if m[1] else re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2]), net)
    return re.sub(r"d{3,}|f+|t+", lambda m: {"d": "EEE" if len(m[0]) == 3 else "EEEE", "f": "S" * len(m[0]), "t": "a"}[m[0][0]], net)


@register("strftime", "date_format")
def strftime(ctx: Context, form: Column, x: Column) -> Column:
    return F.date_format(stamp(ctx, x), java_pattern(str(ctx.literal(0))))


@register("epoch_ms")
def epoch_ms(ctx: Context, x: Column) -> Column:
    """Milliseconds of a timestamp; a timestamp of milliseconds."""
    return F.timestamp_millis(x) if isinstance(ctx.type(x), T.NumericType) else F.unix_millis(stamp(ctx, x))


for _names, _f in {
    ("date", "to_date"): lambda ctx, x: day(ctx, x),
    ("datetime",): lambda ctx, x: stamp(ctx, x),
    ("timestamp", "to_timestamp"): lambda ctx, x: stamp(ctx, x),
    ("to_epoch_ms", "epoch_ms_from_timestamp"): lambda ctx, x: F.unix_millis(stamp(ctx, x)),
    ("to_epoch_us", "epoch_us_from_timestamp"): lambda ctx, x: F.unix_micros(stamp(ctx, x)),
    ("to_epoch_s", "epoch_s_from_timestamp", "epoch_secs"): lambda ctx, x: F.unix_seconds(stamp(ctx, x)),
    ("epoch_us",): lambda ctx, x: F.unix_millis(stamp(ctx, x)) * 1000,
    ("dayname",): lambda ctx, x: F.date_format(stamp(ctx, x), "EEEE"),
    ("monthname",): lambda ctx, x: F.date_format(stamp(ctx, x), "MMMM"),
    ("last_day",): lambda ctx, x: F.last_day(day(ctx, x)),
}.items():
    register(*_names)(_f)

plain(
    now=lambda: F.current_timestamp(), current_date=lambda: F.current_date(),
    tomorrow=lambda: F.date_add(F.current_date(), 1), yesterday=lambda: F.date_sub(F.current_date(), 1),
    current_time=lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    make_date=lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd"),
    make_timestamp=lambda y, mo, d, *time: F.try_make_timestamp(*(x.cast("int") for x in (y, mo, d, *time[:2])), *(F.lit(0) for _ in range(2 - len(time[:2]))), time[2] if len(time) > 2 else F.lit(0)),
    from_epoch_ms=F.timestamp_millis, from_epoch=F.timestamp_seconds, from_epoch_us=lambda u: F.timestamp_millis(F.call_function("div", u, F.lit(1000))),
    ms_to_timestamp=lambda x: F.timestamp_millis(x), us_to_timestamp=lambda x: F.timestamp_micros(x), epoch_s=lambda x: F.timestamp_seconds(x),
)
alias(now="current_timestamp utc_timestamp getdate", current_date="today")


# ---------------------------------------------------------------- intervals
def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(col(months, "int").alias("months"), col(days, "int").alias("days"), col(micros, "long").alias("micros"))


_UNITS = {"year": ("months", 12), "month": ("months", 1), "week": ("days", 7), "day": ("days", 1), "hour": ("micros", 3_600_000_000), "minute": ("micros", 60_000_000), "second": ("micros", 1_000_000), "millisecond": ("micros", 1000), "microsecond": ("micros", 1)}


def parse_interval(s: Column) -> Column:
    """'1 year 2 days 3 hours'; any number of units in any order, singular or plural."""
    total: dict[str, Column] = {"months": F.lit(0.0), "days": F.lit(0.0), "micros": F.lit(0.0)}
    for name, (f, size) in _UNITS.items():
        found = F.regexp_extract_all(F.lower(s), F.lit(rf"(-?\d+(?:\.\d+)?)\s*{name}s?\b"), F.lit(1))
        total[f] = total[f] + size * F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(s.isNotNull(), interval(total["months"], total["days"], total["micros"]))


plain(
    interval=parse_interval, to_years=lambda n: interval(months=n * 12), to_months=lambda n: interval(months=n), to_days=lambda n: interval(days=n),
    to_hours=lambda n: interval(micros=n * 3_600_000_000), to_minutes=lambda n: interval(micros=n * 60_000_000), to_seconds=lambda n: interval(micros=n * 1_000_000),
    to_milliseconds=lambda n: interval(micros=n * 1000), to_microseconds=lambda n: interval(micros=n),
)
alias(interval="duration to_interval")
