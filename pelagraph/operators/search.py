"""Full-text search with BM25, and exact vector search with and without an index.

An index is a set of DataFrames (postings, document lengths), not a structure of its own: a query is a filter
of the postings to its terms, one aggregation by document and a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.functions import vectors
from pelagraph.storage import cut

# English stop words.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B, PHRASE_BONUS = 1.2, 0.75, 2.0


@lru_cache(maxsize=200_000)
def stem_word(w: str) -> str:
    """Porter's algorithm (1980), by its published rules."""
    if len(w) <= 2:
        return w

    def kinds(s: str) -> str:
        out = ""
        for i, ch in enumerate(s):
            v = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
            out += "v" if v else "c"
        return out

    def measure(s: str) -> int:
        k = kinds(s)
        return sum(1 for a, b in zip(k, k[1:], strict=False) if a == "v" and b == "c")

    has_vowel = lambda s: "v" in kinds(s)
    doubled = lambda s: len(s) > 1 and s[-1] == s[-2] and kinds(s)[-1] == "c"
    cvc = lambda s: len(s) > 2 and kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (_STEP2, _STEP3):
        for end, to in step:
            if w.endswith(end):
                w = w[: -len(end)] + to if measure(w[: -len(end)]) > 0 else w
                break
    for end in _STEP4:
        if w.endswith(end):
            head = w[: -len(end)]
            if measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if measure(w) > 1 and doubled(w) and w.endswith("l"):
        w = w[:-1]
    return w


# The endings of the stemmer's steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ment", "ent", "ance", "ence", "able", "ible", "ant", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ws: [stem_word(w) for w in ws], na_action="ignore")


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Words [a-zA-Z0-9]+ in lower case without stop words; null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return _stem_all(words) if stemmed else words


@dataclass
class TextIndex:
    """postings: term, doc, tf; lengths: doc, length; words: doc and its words in order, not written.

    Only phrases need places. They are written at the first query for a phrase.
    """

    postings: DataFrame
    lengths: DataFrame
    words: DataFrame
    table: str = ""
    properties: tuple[str, ...] = ()
    stemmed: bool = True
    places: DataFrame | None = None

    @staticmethod
    def build(rows: DataFrame, key: str, properties: list[str], stemmed: bool = True, table: str = "") -> TextIndex:
        text = F.concat_ws(" ", *(F.col(f"`{p}`").cast("string") for p in properties))
        docs = rows.select(F.col(f"`{key}`").alias("doc"), tokens(text, stemmed).alias("words"))
        postings = cut(docs.select("doc", F.explode("words").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf")), "postings")
        sizes = postings.groupBy(F.col("doc").alias("k")).agg(F.sum("tf").alias("length"))
        lengths = docs.select("doc").join(sizes, F.col("doc") == F.col("k"), "left").select("doc", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
        return TextIndex(postings, cut(lengths, "lengths"), docs, table, tuple(properties), stemmed)

    def positions(self, terms: list[str]) -> DataFrame:
        """term, doc, positions"""
        if self.places is None:
            each = self.words.select("doc", F.posexplode("words").alias("at", "term"))
            self.places = cut(each.groupBy("term", "doc").agg(F.sort_array(F.collect_list("at")).alias("positions")), "positions")
        return self.places.where(F.col("term").isin(terms))

    def updated(self, rows: DataFrame, key: str) -> TextIndex:
        """With the documents of rows added or replaced."""
        new = TextIndex.build(rows, key, list(self.properties), self.stemmed, self.table)
        gone = new.lengths.select(F.col("doc").alias("k"))
        left = lambda df: df.join(gone, F.col("doc") == F.col("k"), "left_anti")
        both = lambda name: left(getattr(self, name)).unionByName(getattr(new, name))
        return TextIndex(cut(both("postings"), "postings"), cut(both("lengths"), "lengths"), both("words"), self.table, self.properties, self.stemmed)

    def terms(self, query: str) -> list[str]:
        one = self.lengths.sparkSession.range(1).select(tokens(F.lit(query), self.stemmed).alias("w")).first()
        return list(one["w"])

    def search(self, query: str, k: int = 10, conjunctive: bool = False, phrase: bool = False, k1: float = K1, b: float = B) -> DataFrame:
        """(doc, score), best first; ties by doc. phrase: a bonus for each place where the next term follows."""
        terms = self.terms(query)
        wanted = list(dict.fromkeys(terms))
        stats = self.lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
        hits = self.postings.where(F.col("term").isin(wanted) if wanted else F.lit(False))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        rows = hits.join(F.broadcast(df), "term").join(self.lengths, "doc").crossJoin(F.broadcast(stats))  # df: one row a term
        idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        agg = [F.sum(idf * tf).alias("score"), F.count("*").alias("n")]
        if phrase and wanted:
            rows = rows.join(self.positions(wanted), ["term", "doc"])
            agg.append(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        out = rows.groupBy("doc").agg(*agg)
        if conjunctive:
            out = out.where(F.col("n") == len(wanted))
        if phrase and wanted:
            bonus = F.lit(0.0)
            for x, y in zip(terms, terms[1:], strict=False):
                here, there = F.coalesce(F.col("at")[x], F.array().cast("array<int>")), F.coalesce(F.col("at")[y], F.array().cast("array<int>"))
                bonus = bonus + PHRASE_BONUS * F.size(F.array_intersect(F.transform(here, lambda p: p + 1), there))
            out = out.withColumn("score", F.col("score") + bonus)
        return out.select("doc", "score").orderBy(F.desc("score"), "doc").limit(k)


@dataclass
class Cells:
    """An exact index: vectors dealt to cells around centres, so that a query skips cells that cannot hold a neighbour.

    Centres come from a sample of at most SAMPLE vectors (Lloyd's rounds). Every vector is in the cell of its nearest centre,
    written as a partition of its own, with the cell's greatest distance to its centre, the radius. For cosine, vectors are
    scaled to length 1. A query reads the cell with the nearest centre first; its k-th distance is a bound, and only cells
    that the triangle inequality lets reach it are read besides. Vectors that are null, of another length or hold null
    or non-finite components are in a cell of their own, which is read always. An index is of the rows it was built from.
    """

    SAMPLE, ROUNDS = 16_384, 8
    rows: DataFrame
    centres: np.ndarray
    radii: dict[int, float]
    metric: str

    @staticmethod
    def build(rows: DataFrame, key: str, vector: str, metric: str) -> Cells | None:
        v = F.col(f"`{vector}`").cast("array<double>")
        rows = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("embedding"), v.alias("v"))
        n = rows.count()
        drawn = rows.where(F.size("v") > 0).orderBy(F.xxhash64("id")).limit(Cells.SAMPLE).select("v").collect()
        size = max(set(map(len, got)), key=list(map(len, got)).count) if (got := [r["v"] for r in drawn]) else 0
        x = np.array([g for g in got if len(g) == size and None not in g], np.float64).reshape(-1, max(1, size))
        x = Cells.scaled(x[np.isfinite(x).all(axis=1)], metric)
        if len(x) == 0:
            return None
        centres = x[np.random.default_rng(5).permutation(len(x))[: max(1, min(256, int(np.sqrt(n)), len(x)))]]
        for _ in range(Cells.ROUNDS):
            near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
            count = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)

        @F.pandas_udf("struct<cell:int,far:double>")
        def place(vs: pd.Series) -> pd.DataFrame:
            ok = vs.map(lambda y: y is not None and len(y) == size and bool(np.isfinite(np.array(y, np.float64)).all()))
            cell, far = np.full(len(vs), -1, np.int32), np.zeros(len(vs))
            if ok.any():
                y = Cells.scaled(np.stack(vs[ok].map(lambda z: np.asarray(z, np.float64)).tolist()), metric)
                d = np.sqrt(np.maximum(0, ((y[:, None, :] - centres[None, :, :]) ** 2).sum(2))) if len(y) * centres.size < 10_000_000 else np.stack([np.sqrt(((z - centres) ** 2).sum(1)) for z in y])
                cell[ok.to_numpy()], far[ok.to_numpy()] = d.argmin(1), d.min(1)
            return pd.DataFrame({"cell": cell, "far": far})

        placed = rows.withColumn("p", place("v")).select("id", "embedding", F.col("p.cell").alias("cell"), F.col("p.far").alias("far"))
        kept = cut(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell"), "cells", "cell")
        radii = {r["cell"]: r["far"] for r in kept.groupBy("cell").agg(F.max("far").alias("far")).collect()}
        return Cells(kept.drop("far"), centres, radii, metric)

    @staticmethod
    def scaled(x: np.ndarray, metric: str) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1) if metric == "cosine" else x

    def floor(self, q: np.ndarray) -> dict[int, float]:
        """For each cell the least distance, in the metric's terms, that one of its vectors can have from q."""
        y = self.scaled(q[None, :], self.metric)[0]
        out = {-1: -np.inf}
        for cell, radius in self.radii.items():
            if cell >= 0:
                gap = max(0.0, float(np.linalg.norm(self.centres[cell] - y)) - radius)
                out[cell] = {"l2": gap, "cosine": gap * gap / 2, "dotproduct": -float(self.centres[cell] @ y) - radius * float(np.linalg.norm(y))}[self.metric]
        return {c: f - 1e-9 * (1 + abs(f)) for c, f in out.items() if c in self.radii}

    def nearest(self, query: list[float], k: int) -> DataFrame:
        q = np.array(query, np.float64)
        if len(q) != self.centres.shape[1]:
            return nearest(self.rows, "id", "embedding", query, k, self.metric)
        floors = self.floor(q)
        first = min((c for c in floors if c >= 0), key=lambda c: (floors[c], float(np.linalg.norm(self.centres[c] - q)), c))
        got = nearest(self.rows.where(F.col("cell") == first), "id", "embedding", query, k, self.metric).select("distance").collect()
        bound = max(r["distance"] for r in got) if len(got) == k else np.inf
        reach = [c for c, f in floors.items() if f <= bound + 1e-9]
        return nearest(self.rows.where(F.col("cell").isin(reach)), "id", "embedding", query, k, self.metric)


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(rank, id, distance, embedding) by exact search: one scan and a top-k. dotproduct: the negated product."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(f"`{vector}`")
    distance = {"cosine": lambda: vectors.cosine_similarity(v, q) * -1 + 1, "l2": lambda: F.sqrt(vectors.squared_distance(v, q)), "dotproduct": lambda: -vectors.inner_product(v, q)}[metric]()
    top = rows.select(F.col(f"`{key}`").alias("id"), distance.alias("distance"), v.alias("embedding")).where("distance is not null").orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy("distance", "id"))).select("rank", "id", "distance", "embedding")
