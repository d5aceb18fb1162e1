"""URL filters by a temporal list join.

A list is a history of dated entries: on a day a pattern is added to it or removed. Each pattern's history
becomes half-open validity intervals ``[from, until)``. A capture is tested against the entries in force at
its fetch time: an as-of join on the capture's keys, which are its host, every parent domain, and its host
with every leading part of its path, as deep as the deepest pattern.

DataFrame functions only. Captures are grouped to distinct (host, path, day) first, so a hot host does not
multiply its matches; intervals join by equality of the key and containment of the time. The interval side
is broadcast only if it has at most ``BROADCAST_ROWS`` rows, counted; beyond, its rows are repeated for
``SALTS`` salts, so that one frequent key is split over as many tasks.

Patterns: ``example.org`` matches that host and every host below; ``example.org/a/b`` matches that host
(with or without a leading www.) and paths that continue it at a slash.

Defined results: null or malformed URL, or null time: no match, kept. Several entries of a pattern and list
at one time: a removal wins. A removal without addition, or an addition within an interval, changes nothing.
An entry without pattern, list or time is ignored. A capture matched by several lists is one row with all of
their names, sorted. Repeated captures are judged each. Empty lists keep all. Extra columns of the captures
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS, SALTS = 100_000, 32
#: Scheme, then host without user and port; the path up to query or fragment.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without leading www. and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"^www\.|\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def keys(h: Column, p: Column, depth: int) -> Column:
    """The patterns that can match: the host's suffixes, and the host with each leading part of the path, of at most depth names."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n_parts = F.least(F.size(parts), F.lit(depth))
    leading = F.when(n_parts > 0, F.transform(F.sequence(F.lit(1), n_parts), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, leading))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, pattern, action ('add' or 'remove'), at. -> (list, pattern, valid_from, valid_until; null: open)."""
    e = entries.where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index("pattern", "/", 1)), r"^www\.", ""), r"\.$", "")
    rest = F.regexp_extract("pattern", r"^[^/]*(/.*?)/*$", 1)
    e = e.select("list", F.concat(plain, rest).alias("pattern"), "at", (F.col("action") == "add").alias("on"))
    e = e.groupBy("list", "pattern", "at").agg(F.min("on").alias("on"))  # false, a removal, wins
    w = W.partitionBy("list", "pattern").orderBy("at")
    e = e.withColumn("before", F.lag("on").over(w)).where(F.col("on") != F.coalesce("before", F.lit(False)))
    return e.withColumn("valid_until", F.lead("at").over(w)).where("on").select("list", "pattern", F.col("at").alias("valid_from"), "valid_until")


def as_of(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Distinct (host, path, time) of the captures that entries in force match, with the lists' names."""
    seen = captures.select(host(F.col(url_col)).alias("h"), path(F.col(url_col)).alias("p"), F.col(time_col).alias("t")).where("h != '' and t is not null").distinct()
    spans = intervals(entries)
    names = F.size(F.filter(F.split(F.col("pattern"), "/"), lambda x: x != "")) - 1
    depth = spans.agg(F.coalesce(F.max(names), F.lit(0))).first()[0]
    keyed = seen.withColumn("key", F.explode(keys(F.col("h"), F.col("p"), depth)))
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(spans), keyed["key"] == spans["pattern"])
    else:
        spread = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("h", "p", "t"), F.lit(SALTS)).cast("int"))
        met = keyed.join(spread, (keyed["key"] == spread["pattern"]) & (keyed["salt"] == spread["salt"])).drop("salt")
    met = met.where((F.col("t") >= F.col("valid_from")) & (F.col("valid_until").isNull() | (F.col("t") < F.col("valid_until"))))
    return met.groupBy("h", "p", "t").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("listed_since"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(page_id, host, fetched_at, lists (null: none), listed_since, blocked) of each capture."""
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(time_col).alias("fetched_at"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("p"))
    hits = as_of(captures, entries, url_col, time_col)
    out = rows.join(hits, (rows["host"] == hits["h"]) & (rows["p"] == hits["p"]) & (rows["fetched_at"] == hits["t"]), "left")
    return out.select("page_id", "host", "fetched_at", "lists", "listed_since", F.col("lists").isNotNull().alias("blocked"))
