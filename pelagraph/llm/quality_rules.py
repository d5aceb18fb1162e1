"""Quality rules with risk-controlled thresholds.

Base counts come from whole texts; three signals follow from them: symbols a character, repeated lines a
line, repeated words a word. The cut-offs are chosen so that, with confidence ``1 - DELTA`` over all strata
at once, at most the share ``ALPHA`` of a stratum's good documents is rejected by them:

* Strata are all languages that have labelled documents; null is one of its own. A language without any has no level,
  and rejects nothing.
* Of the labelled documents, half (by crc32 of the id) is for the fit: for each stratum the quantiles of
  each signal among good documents. A document's badness is the highest quantile, over the signals, that
  it exceeds (0 to ``LEVELS``). Rejecting from a level on gives a nested family of rules.
* The other half is the holdout. From the most lenient rule on, each is tested with the exact binomial tail
  of "the false rejection rate exceeds ALPHA" given how many good holdout documents it rejects; testing in
  this fixed order needs no further correction within a stratum, and Bonferroni's correction covers the
  strata. The last rule before the first failure is used; a stratum where none passes rejects nothing.

Defined results: null or empty text: all counts 0, base_failed. Labels that disagree on a document count as
good; null labels and ids are ignored. Repeated rows are judged each. An empty table gives no rows; without
labels only the base rule acts. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pelagraph.llm import common as c

#: Tolerated share of good documents rejected in a stratum; chance that the guarantee fails in any.
ALPHA, DELTA = 0.02, 0.05
LEVELS = 200
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOLS = b"#*$%&|<>"
_NULL = "\0null"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SIGNALS = ("symbols", "lines", "words")
RATIOS = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
#: Strata whose three thresholds a join may broadcast.
BROADCAST_STRATA = 10_000
_SLICE = 2_000_000


def counts(texts: list[str | None], memo: c.WordHash) -> np.ndarray:
    """One row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    docs = []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        words = raw.split()
        docs.append(words)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        out[i] = len(words), len(text or "") - len(raw) + sum(map(len, words)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines)
    n = out[:, 0]
    flat = np.fromiter((memo[w] for d in docs for w in d), dtype=np.uint64, count=int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    if len(flat) > 3:
        mix = np.uint64(0x9E3779B97F4A7C15)
        h = flat[:-2].copy()
        for j in (1, 2):
            h = h * mix
            h ^= h >> np.uint64(29)
            h += flat[j : len(flat) - 2 + j]
        h = c.finish(h ^ (doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, times = np.unique(h[inside], return_inverse=True, return_counts=True)
        again = inside[times[inverse] > 1]
        covered = np.zeros(len(flat), bool)
        for j in range(3):
            covered[again + j] = True
        out[:, 4] = np.bincount(doc[covered], minlength=len(texts))
    return out


def _sliced(texts: list[str | None], memo: c.WordHash) -> np.ndarray:
    held, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _SLICE or i + 1 == len(texts):
            held.append(counts(texts[at : i + 1], memo))
            at, size = i + 1, 0
    return np.concatenate(held) if held else np.zeros((0, len(COUNTS)), np.int64)


def base_failed(n: np.ndarray) -> np.ndarray:
    return (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > MAX_REPEAT_PERCENT * n[:, 0])


def signals(n: np.ndarray) -> np.ndarray:
    share = lambda a, b: n[:, a] / np.maximum(n[:, b], 1)
    return np.stack([share(2, 1), share(3, 5), share(4, 0)], 1)


@dataclass
class Rules:
    """For each stratum the signals' quantiles and the level from which documents are rejected."""

    quantiles: dict[str, np.ndarray]
    level: dict[str, int]
    holdout: dict[str, tuple[int, int]]

    def stratum(self, lang: str | None) -> str:
        return _NULL if lang is None else lang

    def badness(self, lang: list[str | None], n: np.ndarray) -> np.ndarray:
        out, s = np.zeros(len(n), np.int64), signals(n)
        names = np.array([self.stratum(x) for x in lang], dtype=object)
        for name in set(names.tolist()) & set(self.quantiles):
            at = names == name
            out[at] = np.max([np.searchsorted(q, s[at, i], side="left") for i, q in enumerate(self.quantiles[name])], axis=0)
        return out

    def rejects(self, lang: list[str | None], n: np.ndarray) -> np.ndarray:
        level = np.array([self.level.get(self.stratum(x), LEVELS + 1) for x in lang], np.int64)
        return self.badness(lang, n) >= level


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial(n, p), summed exactly in logarithms."""
    if n <= 0:
        return 1.0
    i = np.arange(k + 1)
    log = np.vectorize(math.lgamma, otypes=[float])
    return float(np.exp(math.lgamma(n + 1) - log(i + 1) - log(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def certified_level(rejected_from: np.ndarray, n: int, alpha: float, delta: float) -> int:
    """rejected_from[t]: good holdout documents with badness >= t. The lowest level certified, from LEVELS down."""
    level = LEVELS + 1
    for t in range(LEVELS, 0, -1):
        if binomial_tail(int(rejected_from[t]), n, alpha) > delta:
            break
        level = t
    return level


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = c.WordHash()
    for batch in batches:
        n = _sliced(batch.column(2).to_pylist(), memo)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(n[:, i]) for i in range(len(COUNTS)))], names=["doc_id", "lang", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang and COUNTS of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return c.map_arrow(rows, _measure, "doc_id long, lang string, " + ", ".join(f"{x} long" for x in COUNTS))


def fit(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> Rules:
    """measured: a kept table of measure(). labels: doc_id and quality (1 good).

    To the driver comes a row of quantiles a language, and as many histograms of LEVELS + 1 counts.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rows = measured.join(good, "doc_id").where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    rows = rows.select("lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("half"), *COUNTS)
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit(_NULL)))
    grid = [i / LEVELS for i in range(1, LEVELS + 1)]
    exprs = [F.percentile_approx(ratio(a, b), grid, 20_000).alias(s) for s, (a, b) in zip(SIGNALS, RATIOS, strict=True)]
    quantiles = {r["lang"]: np.array([r[s] for s in SIGNALS]) for r in rows.where("half = 0").groupBy("lang").agg(*exprs).collect()}
    rules = Rules(quantiles, {}, {})

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_pylist()
            n = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], 1)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "bad": pa.array(rules.badness(lang, n), pa.int32())})

    seen: dict[str, np.ndarray] = {}
    for r in c.map_arrow(rows.where("half = 1"), levels, "lang string, bad int").groupBy("lang", "bad").count().collect():
        seen.setdefault(r["lang"], np.zeros(LEVELS + 1, np.int64))[r["bad"]] = r["count"]
    for name in quantiles:
        bad = seen.get(name, np.zeros(LEVELS + 1, np.int64))
        rejected = np.cumsum(bad[::-1])[::-1]
        rules.level[name] = certified_level(rejected, int(bad.sum()), alpha, delta / len(quantiles))
        rules.holdout[name] = int(bad.sum()), int(rejected[rules.level[name]]) if rules.level[name] <= LEVELS else 0
    return rules


def judge(measured: DataFrame, rules: Rules) -> DataFrame:
    """measured with base_failed, level (badness) and kept."""
    held = measured.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_pylist()
            n = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], 1)
            failed = base_failed(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(held.value.badness(lang, n)), pa.array(~failed & ~held.value.rejects(lang, n))], names=[*batch.schema.names, "base_failed", "badness", "kept"])

    return c.map_arrow(measured, run, "doc_id long, lang string, " + ", ".join(f"{x} long" for x in COUNTS) + ", base_failed boolean, badness long, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The kept rows of docs, with all their columns.

    Rows are measured once and written with their counts. A level rejects what exceeds any signal's quantile below it, so
    the rules come to three thresholds a stratum, joined by language.
    """
    names = c.fresh(docs, *COUNTS, "stratum", *SIGNALS)
    n, stratum, most = dict(zip(COUNTS, names, strict=False)), names[len(COUNTS)], names[len(COUNTS) + 1 :]
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = c.WordHash()
        for batch in batches:
            got = _sliced(batch.column(text).cast(pa.string()).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[:, i]) for i in range(len(COUNTS)))], names=[*batch.schema.names, *n.values()])

    counted = c.keep(c.map_arrow(docs, run, StructType([*docs.schema.fields, *(StructField(x, LongType()) for x in n.values())])), "counted")
    lang = F.col(f"`{lang_col}`").cast("string")
    rules = fit(counted.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), lang.alias("lang"), *(F.col(v).alias(k) for k, v in n.items())), labels)
    limits = [(x, *(float(v) for v in rules.quantiles[x][:, level - 1])) for x, level in rules.level.items() if level <= LEVELS]
    limits_df = docs.sparkSession.createDataFrame(limits, StructType([StructField(stratum, StringType()), *(StructField(x, DoubleType()) for x in most)]))
    limits_df = F.broadcast(limits_df) if len(limits) <= BROADCAST_STRATA else limits_df
    share = lambda x, y: F.col(n[x]) / F.greatest(F.col(n[y]), F.lit(1))
    over = [share(a, b) > F.col(m) for (a, b), m in zip(RATIOS, most, strict=True)]
    failed = (F.col(n["n_words"]) < MIN_WORDS) | (100 * F.col(n["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(n["n_words"]))
    rows = counted.where(~failed).join(limits_df, F.coalesce(lang, F.lit(_NULL)) == F.col(stratum), "left")
    return rows.where(~F.coalesce(over[0] | over[1] | over[2], F.lit(False))).select(*(F.col(f"`{x}`") for x in docs.columns))
