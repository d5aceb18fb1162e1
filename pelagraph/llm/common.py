"""Shared pieces: kept tables, word and shingle hashing, packed blobs, connected components.

Large shuffles here move *blobs* (packed numpy arrays, one row for thousands of values) instead of one
row for each value: the JVM sees few rows and the arrays are sorted and counted by numpy.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pelagraph.operators.joins import beside_hubs
from pelagraph.storage import cut, drop, importable

#: Multiplier of the rolling mix (2**64 divided by the golden ratio).
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bounds of an Arrow batch; smaller settings of the session stay.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Words whose hash a Python worker remembers before it starts over.
_MEMO_WORDS = 100_000


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; see pelagraph.storage."""
    return cut(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame) -> int:
    """Partitions for a shuffle that carries about as much as df holds."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have (Spark's names ignore case), one for each of names."""
    have, out = {x.lower() for x in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in have:
            name = f"_{name}"
        have.add(name)
        out.append(name)
    return out


def crc_mod(doc_id: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


# ---------------------------------------------------------------- words and shingles
def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters (what bytes.split() cuts at)."""
    return text.lower().split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHash(dict):
    """word -> 64-bit hash, remembered for the batch's repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def content_key(words: list[bytes]) -> int:
    """Signed 64-bit name of a word sequence (0 is kept for the empty one)."""
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed=7) - (1 << 63) if words else 0


def finish(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(32)
    return h * _MIX


def shingle_sets(docs: list[list[bytes]], memo: WordHash, k: int = 5) -> list[np.ndarray]:
    """For each word list the sorted distinct hashes of its k-word shingles; a shorter one is one shingle."""
    flat = np.fromiter((memo[w] for d in docs for w in d), dtype=np.uint64, count=sum(map(len, docs)))
    rolled = flat.copy()
    for j in range(1, k):
        rolled *= _MIX
        rolled ^= rolled >> np.uint64(29)
        rolled[: max(0, len(flat) - j)] += flat[j:]
    rolled = finish(rolled)
    out, at = [], 0
    for d in docs:
        n = len(d)
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(d), seed=n)] if n else [], dtype=np.uint64))
        at += n
    return out


# ---------------------------------------------------------------- blobs
def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted uint32 values as zstandard-compressed byte planes of their differences."""
    d = np.diff(a.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.compress(d.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_sorted(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
    return np.cumsum(raw.reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def split_at(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(part):
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            yield int(part[a]), slice(int(a), int(b))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of a stream that is sorted by key, gathered by key."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with small batches: a Python worker holds one batch of texts at a time."""
    conf = df.sparkSession.conf
    importable(df.sparkSession)
    for key, most in _BATCH.items():
        now = int(re.sub(r"\D", "", conf.get(key)) or 0)
        if now <= 0 or now > most:
            conf.set(key, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return a worker's freed memory to the system: it waits beside the JVM for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- connected components
def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by one edge from each node to its smallest reachable one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([root(x) for x in part], pa.int64())})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the smallest node reached over the undirected edges; nodes without edge are absent.

    Alternating large-star and small-star steps; each partition first keeps only a forest of its edges.
    Every step is written to the shared folder. Only the number of changed rows comes to the driver.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    e = keep(map_arrow(e, _local_forest, "a long, b long"), "forest")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("deg")), "least")
        large = beside_hubs(both.where("b > a"), least, "a", "deg", 2 * e.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = keep(map_arrow(large.distinct(), _local_forest, "a long, b long"), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e, old = keep(small.where("a != b").distinct(), "small"), e
        drop(old, least, large)
        #: A forest of stars: each node has one edge and no star's centre has an edge of its own.
        many = e.groupBy("a").count().where("count > 1").limit(1)
        chained = e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi").limit(1)
        if not many.select("a").unionByName(chained).take(1):
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
