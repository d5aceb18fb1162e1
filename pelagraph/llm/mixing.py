"""Mixing sources to target weights by Poisson replication.

A source with n documents and target share w of N output documents has the mean repetition rate
``w * N / n``. Each document's copies follow the Poisson distribution of that mean, inverted at a uniform
number that an md5 of seed, id and text gives, so a rerun makes the same choice. A rate beyond ``MAX_RATE`` is
cut into equal parts of at most that; each part is inverted at a number of its own, and the counts add up, as
independent Poisson numbers do, to one of the whole rate. Documents are exploded by
their count and dealt to partitions by another hash of seed, id, text and copy, sorted by it within each: a global
shuffle.

DataFrame functions only. The cumulated Poisson probabilities of a source are one array in its row of the
rate table (one row a source). The table is broadcast if it has at most ``SOURCES`` rows, counted; beyond, the
join is Catalyst's, which splits skewed partitions of hot sources.

Defined results: weights None: shares in proportion to ``n ** TEMPER``. A source without weight gets none of
its documents copied; a weight without source is left out, and the rest is scaled to sum to 1. Null source
is a source of its own (key None in weights). Null text counts as empty, null id as the word "null", for
the hash only. Equal rows (same id and text) get the same count. Every rate that the documents themselves lead
to is drawn; if the caller names a total, a rate beyond ``MAX_RATE`` raises instead, as that total asks for more
copies of a source than were meant. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagraph.llm import common as c

TEMPER = 0.5
SEED = 17
MAX_RATE = 200.0
#: Sources (a row of at most 3 KB each) whose rates are broadcast; beyond, Catalyst chooses the join.
SOURCES = 5_000


def poisson_terms(rate: float = MAX_RATE) -> int:
    """Terms after which the tail beyond is under 2**-52 (the uniform number's step)."""
    return int(math.ceil(rate + 9 * math.sqrt(rate) + 24))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, temper: float = TEMPER, total: int | None = None) -> DataFrame:
    """(source, n, rate) for each source with a weight; total: expected documents out, as many as in if None."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        weighted = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sums = weighted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    everything = docs.agg(F.count("*").alias("docs"))
    one = sums.join(everything)  # one row each
    return weighted.join(F.broadcast(one)).select("source", "n", (F.col("w") / F.col("all_w") * (F.lit(total) if total is not None else F.col("docs")) / F.col("n")).alias("rate"))


def bounded(rate: Column) -> Column:
    """The rate; raises beyond MAX_RATE."""
    return F.when(rate > MAX_RATE, F.raise_error(F.lit(f"a source's repetition rate exceeds {MAX_RATE}"))).otherwise(rate)


def parts(rate: Column) -> Column:
    """The number of equal parts, none beyond MAX_RATE, that a rate is drawn in."""
    return F.greatest(F.lit(1), F.ceil(rate / MAX_RATE).cast("int"))


def cdf(rate: Column) -> Column:
    """Cumulated Poisson probabilities up to poisson_terms, for a rate of at most MAX_RATE: e^-rate is positive."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    terms = F.ceil(rate + 9 * F.sqrt(rate) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), terms), start, step)["c"]


def uniforms(id_col: str, text_col: str, count: Column, seed: int = SEED) -> Column:
    """An array of count numbers in [0, 1), each from 52 bits of an md5; the first depends on seed, id and text only."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)

    def number(key: Column) -> Column:
        return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))

    #: The array of one holds key for the inner lambda; concat_ws leaves out the null of the first number.
    each = lambda k: F.transform(F.sequence(F.lit(1), count), lambda i: number(F.concat_ws("|", k, F.when(i > 1, i.cast("string")))))
    return F.transform(F.array(key), each)[0]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, temper: float = TEMPER, total: int | None = None, seed: int = SEED, copies: str = "copies") -> DataFrame:
    """docs with the column copies: how often each row is to appear (rows of sources without weight have gone)."""
    source, probabilities, pieces = c.fresh(docs, "source", "cdf", "parts")
    table = rates(docs, source_col, weights, temper, total)
    few = table.limit(SOURCES + 1).count() <= SOURCES
    rate = F.col("rate") if total is None else bounded(F.col("rate"))
    table = table.withColumn("rate", rate).withColumn(pieces, parts(F.col("rate")))
    table = table.select(F.col("source").alias(source), pieces, cdf(F.col("rate") / F.col(pieces)).alias(probabilities))
    table = F.broadcast(table) if few else table
    joined = docs.join(table, F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    u = uniforms(id_col, text_col, F.col(pieces), seed)
    #: The array holds the numbers for the inner lambda, which would else compute them anew for each probability.
    n = F.aggregate(F.transform(u, lambda x: F.size(F.filter(probabilities, lambda p: p <= x))), F.lit(0), lambda a, b: a + b)
    return joined.withColumn(copies, n).drop(source, probabilities, pieces)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, temper: float = TEMPER, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The replicated documents with docs' columns, in random order over all partitions."""
    copy, at = c.fresh(docs, "copy", "place")
    many = counted(docs, id_col, text_col, source_col, weights, temper, total, seed, copy)
    many = many.withColumn(copy, F.explode(F.when(F.col(copy) > 0, F.sequence(F.lit(1), F.col(copy)))))
    place = F.xxhash64(F.lit(seed), F.lit("place"), F.col(id_col), F.md5(F.col(text_col).cast("string").cast("binary")), F.col(copy))
    dealt = many.withColumn(at, place).repartition(c.width(docs), at).sortWithinPartitions(at)
    return dealt.select(*(F.col(f"`{x}`") for x in docs.columns))
