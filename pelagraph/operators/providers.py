"""Embeddings from a provider that the session is given.

A provider is any picklable object with ``embed(list[str]) -> list[list[float]]``; ``HashProvider`` is one without
a model, for tests. Texts go to it in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelagraph.functions import vectors


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Hashed bag of words, normalised; deterministic."""

    def __init__(self, size: int = 32):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", (t or "").lower()):
                v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % self.size] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def need(session: Any) -> Provider:
    if session.provider is None:
        raise ValueError("the session has no embedding provider")
    return session.provider


def embed(provider: Provider, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.embed(s.fillna("").tolist()))

    return run(text.cast("string"))


def embed_nodes(session: Any, label: str, property_: str) -> DataFrame:
    t = session.catalog.node(label)
    return t.df.select(F.col(t.key).alias("id"), F.col(property_).cast("string").alias("text"), embed(need(session), F.col(property_)).alias("embedding"))


def embed_texts(session: Any, texts: list[str]) -> DataFrame:
    df = session.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "index long, text string")
    return df.withColumn("embedding", embed(need(session), F.col("text")))


def ranked(session: Any, df: DataFrame, query: str, k: int) -> DataFrame:
    """df has embedding; (rank, …, score), best first."""
    q = F.array(*(F.lit(float(x)) for x in need(session).embed([query])[0]))
    keys = [c for c in df.columns if c != "embedding"]
    top = df.withColumn("score", vectors.cosine_similarity(F.col("embedding"), q)).drop("embedding").orderBy(F.desc("score"), *keys).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), *keys))).select("rank", *keys, "score")


def json_items(session: Any, path: str, property_: str) -> DataFrame:
    from pelagraph.sources import readers

    return readers.read_json(session.spark, path).withColumn("text", F.col(property_).cast("string"))


def ingest(session: Any, path: str, label: str, key: str, property_: str) -> DataFrame:
    """Adds a JSON file's objects to a node table (made if missing), with their embeddings."""
    rows = json_items(session, path, property_).withColumn("embedding", embed(need(session), F.col("text"))).drop("text")
    if label in session.catalog.nodes:
        old = session.catalog.node(label).df
        session.catalog.replace_node(label, old.unionByName(rows.join(old, key, "left_anti").select(*rows.columns), allowMissingColumns=True))
    else:
        session.catalog.add_node(label, rows, key)
    return rows.select(F.count("*").alias("ingested"))
