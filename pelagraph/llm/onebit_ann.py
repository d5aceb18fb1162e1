"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is divided by its norm, padded to the code's length and multiplied by one random rotation; the
signs are its code, packed into 64-bit words. Beside it stand the correction scalars: the norm, the inner product a of
the rotated unit vector with its own sign vector (scaled to length 1), and the number of ones. A query is rotated alike
and its components rounded to ``PLANES`` bits, whose planes are packed too: the inner product of code and query is a
weighted sum of the ones in ``code & plane``. Divided by a it estimates the inner product of the vectors without bias,
with an error above ``EPSILON`` times both norms times ``sqrt(((1 - a^2) / (bits - 1) + step^2 / 12) / a^2)`` only with a
small probability (step: of the query's rounding).

Vectors are packed into blocks of about ``BLOCK``, codes, scalars and the vectors themselves, found by a hash of the id, so
equal vectors spread like any others; the blocks are written once and stay where they are. Queries come to them, in
passes: a pass broadcasts at most ``PASS_BYTES`` of packed queries (the stated query set, in blocks) and reads the
blocks once. In a task a query's floor is the greater of the k-th best inner product it has met and the block's k-th best lower
bound; only vectors whose upper bound reaches the floor are reranked exactly. A task sends each query's k best on, packed, one row
a block of queries, and these are merged. No training: every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows with a null id. Rows that repeat an id count once, with the smallest vector. Only vectors of equal
length are compared. Ties go to the smaller id. Fewer candidates than k: all of them. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pelagraph.llm import common as c

K, BLOCK, QUERIES, PASS_BYTES = 20, 8192, 1024, 32 << 20
#: Bits a dimension, bits of a query's component, width of the error bound, seed of the rotation.
SPREAD, PLANES, EPSILON, SEED = 4, 4, 2.4, 11


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """dim rows of a random orthogonal matrix of bits columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def bits_for(dim: int) -> int:
    return -(-SPREAD * dim // 64) * 64


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def _turned(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, rotated unit vectors); scaled first, so that no square leaves the range of doubles."""
    top = np.abs(x).max(axis=1)
    unit = x / top[:, None]
    size = np.linalg.norm(unit, axis=1)
    return top * size, (unit / size[:, None]) @ turn


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of 64-bit words, norms, a, ones) of the rows of x."""
    norm, y = _turned(x, turn)
    return _words(y > 0), norm, np.abs(y).sum(1) / np.sqrt(y.shape[1]), (y > 0).sum(1).astype(np.int64)


def encode_queries(q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes: rows of PLANES codes, scalars: rows of norm, least component, step and sum of the rounded components)."""
    norm, y = _turned(q, turn)
    low = y.min(axis=1)
    step = (y.max(axis=1) - low) / (2**PLANES - 1)
    step = np.where(step > 0, step, 1.0)
    u = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([_words((u >> p) & 1) for p in range(PLANES)], axis=1)
    return planes, np.stack([norm, low, step, u.sum(1, dtype=np.int64)], axis=1)


def estimate(codes: np.ndarray, norm: np.ndarray, a: np.ndarray, ones: np.ndarray, planes: np.ndarray, scalars: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of a query with coded vectors, error bounds), from packed bits and scalars alone."""
    bits = codes.shape[1] * 64
    hits = np.zeros(len(codes), np.int64)
    for p in range(PLANES):
        hits += np.bitwise_count(codes & planes[p]).sum(axis=1, dtype=np.int64) << p
    q_norm, low, step, total = scalars
    signed = (2 * step * hits + 2 * low * ones - step * total) / np.sqrt(bits) - np.sqrt(bits) * low
    scale = norm * (q_norm / a)
    return signed * scale, epsilon * scale * np.sqrt(np.maximum(0, 1 - a * a) / (bits - 1) + step * step / 12)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, each row by the same sequence of additions."""
    return np.multiply(x, q, dtype=np.float64).sum(axis=-1)


def _kth(low: np.ndarray, k: int) -> float:
    return float(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else -np.inf


def _pack_blocks(queries: bool, kind: str):
    """Rows (dim, blk, vec_id, embedding), sorted by block, into one row a block: codes, scalars and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            dim, blk = t.column("dim")[0].as_py(), t.column("blk")[0].as_py()
            o = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
            x = t.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)[o]
            turn = rotation(dim, bits_for(dim))
            if queries:
                codes, scalars = encode_queries(x, turn)
            else:
                codes, *rest = encode(x, turn)
                scalars = np.stack(rest, axis=1).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "blk": pa.array([blk], pa.int64()), "ids": [t.column("vec_id").to_numpy()[o].tobytes()], "codes": [codes.tobytes()], "scalars": [scalars.tobytes()], "x": [x.astype(kind).tobytes()]})

        for batch in batches:
            key = np.stack([batch.column("dim").to_numpy(), batch.column("blk").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero(np.any(np.diff(key, axis=0) != 0, axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and (held[0].column("dim")[0], held[0].column("blk")[0]) != (part.column("dim")[0], part.column("blk")[0]):
                    yield from flush()
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from flush()

    return run


def _blocks(rows: DataFrame, size: int, queries: bool, kind: str) -> DataFrame:
    """Packed blocks of about size vectors of one dimension."""
    counts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("blocks"))
    dealt = rows.join(F.broadcast(counts), "dim").withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")  # one row a dimension
    dealt = dealt.select("dim", "blk", "vec_id", "embedding").repartition(c.width(rows), "dim", "blk").sortWithinPartitions("dim", "blk")
    return c.keep(c.map_arrow(dealt, _pack_blocks(queries, kind), "dim int, blk long, ids binary, codes binary, scalars binary, x binary"), "blocks")


class _Best:
    """The k best found so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n

    def floor(self, j: int) -> float:
        return float(self.scores[j][-1]) if len(self.scores[j]) == self.k else -np.inf

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[j], ids]), np.concatenate([self.scores[j], scores])
        o = np.lexsort((ids, -scores))[: self.k]
        self.ids[j], self.scores[j] = ids[o], scores[o]

    def row(self) -> tuple[bytes, bytes, bytes]:
        return np.array([len(x) for x in self.ids], np.int32).tobytes(), np.concatenate(self.ids).tobytes(), np.concatenate(self.scores).tobytes()


def meet(block: dict, asked: dict, best: _Best, kind: str) -> int:
    """Search a block of vectors for a block of queries of the same dimension; the number of vectors reranked."""
    ids, dim = np.frombuffer(block["ids"], np.int64), block["dim"]
    x, words = np.frombuffer(block["x"], kind).reshape(len(ids), dim), bits_for(dim) // 64
    codes = np.frombuffer(block["codes"], np.uint64).reshape(len(ids), words)
    norm, a, ones = np.ascontiguousarray(np.frombuffer(block["scalars"], np.float64).reshape(-1, 3).T)
    q_ids = np.frombuffer(asked["ids"], np.int64)
    planes = np.frombuffer(asked["codes"], np.uint64).reshape(len(q_ids), PLANES, words)
    scalars, q = np.frombuffer(asked["scalars"], np.float64).reshape(-1, 4), np.frombuffer(asked["x"], kind).reshape(len(q_ids), dim)
    reranked = 0
    for j in range(len(q_ids)):
        est, width = estimate(codes, norm, a, ones, planes[j], scalars[j])
        other = ids != q_ids[j]
        floor = max(best.floor(j), _kth(np.where(other, est - width, -np.inf), best.k))
        near = np.flatnonzero((est + width >= floor) & other)
        reranked += len(near)
        best.add(j, ids[near], inner(x[near].astype(np.float64), q[j].astype(np.float64)))
    return reranked


_FOUND = "q_blk long, dim int, n binary, ids binary, scores binary"


def _pass(held, k: int, kind: str):
    """Blocks of vectors -> for each block of the pass' queries its k best in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        best = {i: _Best(len(r["ids"]) // 8, k) for i, r in enumerate(asked)}
        seen: set[int] = set()
        for batch in batches:
            for block in batch.to_pylist():
                for i, r in enumerate(asked):
                    if r["dim"] == block["dim"]:
                        meet(block, r, best[i], kind)
                        seen.add(i)
        for i in sorted(seen):
            yield pa.RecordBatch.from_arrays([pa.array([asked[i]["blk"]], pa.int64()), pa.array([asked[i]["dim"]], pa.int32()), *(pa.array([b], pa.binary()) for b in best[i].row())], names=["q_blk", "dim", "n", "ids", "scores"])

    return run


def _merge(held, k: int):
    """The tasks' rows, sorted by block of queries -> (query_id, rank, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids = {(r["dim"], r["blk"]): np.frombuffer(r["ids"], np.int64) for r in held.value}
        name, best = None, _Best(0, k)

        def out() -> Iterator[pa.RecordBatch]:
            if name is not None:
                n = [len(x) for x in best.ids]
                rank = np.concatenate([np.arange(1, m + 1) for m in n]) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[name], n)), pa.array(rank.astype(np.int32)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["dim"], r["q_blk"]) != name:
                    yield from out()
                    name = r["dim"], r["q_blk"]
                    best = _Best(len(q_ids[name]), k)
                ends = np.cumsum(np.frombuffer(r["n"], np.int32))
                ids, scores = np.split(np.frombuffer(r["ids"], np.int64), ends[:-1]), np.split(np.frombuffer(r["scores"], np.float64), ends[:-1])
                for j, (x, y) in enumerate(zip(ids, scores, strict=True)):
                    best.add(j, x, y)
        yield from out()

    return run


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, embedding of doubles): the vectors that take part, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query (over vec_id) holds, its k nearest others."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType) else "<f8"
    rows = c.keep(valid(vectors, id_col, vector_col), "vectors")
    base, asked = _blocks(rows, block, False, kind), _blocks(rows.where(is_query), queries, True, kind)
    size = F.length("ids") + F.length("codes") + F.length("scalars") + F.length("x")
    todo = asked.select("dim", "blk", size.alias("size")).orderBy("dim", "blk").toLocalIterator()  # three numbers a block of queries
    found: list[DataFrame] = []

    def run(chosen: list[tuple[int, int]]) -> None:
        mine = asked.where(F.struct("dim", "blk").isin([F.struct(F.lit(d).cast("int"), F.lit(b).cast("long")) for d, b in chosen]))
        held = spark.sparkContext.broadcast([r.asDict() for r in mine.collect()])
        parts = c.map_arrow(base, _pass(held, k, kind), _FOUND)
        dealt = parts.repartition(min(c.width(base), len(chosen)), "dim", "q_blk").sortWithinPartitions("dim", "q_blk")
        found.append(c.keep(c.map_arrow(dealt, _merge(held, k), "query_id long, rank int, vec_id long, score double"), "nearest"))
        held.unpersist()

    chosen, total = [], 0
    for r in todo:
        if chosen and total + r["size"] > pass_bytes:
            run(chosen)
            chosen, total = [], 0
        chosen.append((r["dim"], r["blk"]))
        total += r["size"]
    if chosen:
        run(chosen)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
