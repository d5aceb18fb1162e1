"""Packing by non-negative least squares over shallow length combinations.

Every document becomes token ids (byte-level BPE, 50,257 ids) and one end id. It is cut at multiples of the
window: whole windows are sequences of their own, the rest is one piece. The pieces (lengths and checksums, no ids) are written,
counted, and dealt by a hash into shards of about ``shard_pieces``, so no task holds more whatever the input. In a shard:

1. Lengths, rounded up to the grid, make a histogram h.
2. All combinations of up to ``depth`` lengths that fill the window exactly are enumerated; column s of A
   holds how often each length occurs in combination s.
3. ``min |A x - h|, x >= 0`` is solved by the active-set method; x, rounded, says how often each combination
   is used, as far as pieces of its lengths are left.
4. What is left is packed greedily: longest first, into the open sequence with the least room that holds it.

Ids come from the library whose results are the contract's (``tokenizers``) where a text holds a character
from U+0240 on, else from ``tiktoken`` with the same vocabulary, four times as fast; a test holds both equal.

Defined results: null text is empty text (one piece, the end id alone); a repeated row is packed again; a
null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagraph.llm import common as c

WINDOW, GRID, DEPTH = 2048, 8, 3
END_ID = 1
SHARD_PIECES = 16_384

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
#: First bytes of UTF-8 characters from U+0240 on.
_BEYOND = re.compile(rb"[\xc9-\xf4]")


@lru_cache(maxsize=2)
def _fast(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _full(json_path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(json_path)
    t.encode_special_tokens = True
    return t


def token_ids(text: str, json_path: str | None = None, ranks_path: str | None = None) -> np.ndarray:
    """Ids of a text without the end id."""
    import public_tokenizers as p

    if not text:
        return np.array([], "<u4")
    if _BEYOND.search(text.encode("utf-8", "replace")):
        return np.array(_full(json_path or p.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(_fast(ranks_path or p.path("byte_bpe_50k.tiktoken"), p.PATTERN).encode_ordinary(text), "<u4")


def _pieces(window: int, end_id: int, json_path: str | None, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", json_path, ranks_path), np.uint32(end_id)).astype("<u4")
                for a, b in pairwise([*range(0, len(ids), window), len(ids)]):
                    rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)))
            yield c.emit(_ARROW, rows)

    return run


def combinations(bins: int, depth: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Non-decreasing tuples of 2 to depth lengths, all present, that sum to bins."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        least = head[-1] if head else 1
        if head and left >= least and present[left]:
            found.append((*head, left))
        if len(head) + 2 <= depth:
            for x in range(least, left // 2 + 1):
                if present[x] and left - x >= x:
                    grow((*head, x), left - x)

    grow((), bins)
    return found


def nnls(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """min |a x - h|, x >= 0, by the active-set method of Lawson and Hanson on the normal equations."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-6 * max(1.0, float(h.max(initial=0)))
    for _ in range(3 * a.shape[0]):
        w = a.T @ (h - a @ x)
        w[passive] = -np.inf
        if not len(w) or w.max() <= tol:
            break
        passive[int(w.argmax())] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.solve(a[:, at].T @ a[:, at] + 1e-9 * np.eye(len(at)), a[:, at].T @ h)
            if len(s) == 0 or s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-12))
            x[at] += step * (s - x[at])
            passive[at[(x[at] <= 1e-9)]] = False
            x[~passive] = 0
    return x


def plan(lengths: np.ndarray, window: int, grid: int, depth: int) -> list[list[int]]:
    """Positions of the pieces of each sequence."""
    whole = np.flatnonzero(lengths >= window)
    out = [[int(i)] for i in whole]
    bins = window // grid
    size = -(-lengths // grid)
    rest = np.flatnonzero(lengths < window)
    stock: dict[int, list[int]] = {int(b): rest[size[rest] == b][::-1].tolist() for b in np.unique(size[rest])}
    h = np.zeros(bins + 1)
    for b, at in stock.items():
        h[b] = len(at)
    if found := combinations(bins, depth, h > 0):
        a = np.zeros((bins + 1, len(found)))
        for s, combo in enumerate(found):
            for b in combo:
                a[b, s] += 1
        times = nnls(a, h)
        for s in np.argsort(-times, kind="stable"):
            n = int(round(times[s]))
            if n <= 0:
                break
            n = min(n, *(len(stock[b]) // found[s].count(b) for b in set(found[s])))
            out += [[stock[b].pop() for b in found[s]] for _ in range(n)]
    room: dict[int, list[list[int]]] = {}
    free: list[int] = []  # the sizes of room that some open sequence has, ascending
    from bisect import bisect_left, insort

    left = sorted((i for at in stock.values() for i in at), key=lambda i: (-lengths[i], i))
    for i in left:
        n = int(lengths[i])
        at = bisect_left(free, n)
        if at < len(free):
            have = free[at]
            seq = room[have].pop()
            if not room[have]:
                del room[have]
                free.pop(at)
        else:
            have, seq = window, []
            out.append(seq)
        seq.append(i)
        if have - n > 0:
            if have - n not in room:
                insort(free, have - n)
            room.setdefault(have - n, []).append(seq)
    return out


def _pack(window: int, grid: int, depth: int):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        t = group.drop_columns(["shard"]).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_numpy()
        seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s, at in enumerate(plan(lengths, window, grid, depth)):
            seq[at] = (shard << 32) + s
            offset[at] = np.cumsum([0, *lengths[at[:-1]]])
        return t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grid: int = GRID, depth: int = DEPTH, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = c.keep(c.map_arrow(texts, _pieces(window, end_id, json_path, ranks_path), _PIECE), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(window, grid, depth), f"{_PIECE}, sequence_id long, offset long")
