"""Core numbers by blocks of vertices.

Vertices are dealt by ranges of ids to blocks of about BLOCK edges' ends. A block holds its vertices' neighbours and the last
number heard of those in other blocks, and lowers its own numbers until none changes; then it tells other blocks which of
those they read have fallen. Rounds end when nobody has anything to tell. Blocks that hear nothing are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagraph.storage import cut, drop, importable

#: Ends of edges in a block, about.
BLOCK = 3_000_000
#: A vertex of more neighbours would make a block too large.
WIDEST = 4 * BLOCK
#: What is not heard yet.
_UNHEARD = np.int32(2**31 - 1)
_ROWS = "block int, kind string, peer int, data binary"
_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("peer", pa.int32()), ("data", pa.binary())])


def core_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(id, core), or None if a vertex has too many neighbours for a block.

    Ids are longs, edges pairs src <> dst in any direction; both may repeat, and are read several times.
    """
    importable(edges.sparkSession)
    ends = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    total, most = ends.groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > WIDEST:
        return None
    blocks = -(-total // BLOCK) or 1
    near = cut(ends.repartitionByRange(blocks, "src").mapInArrow(_neighbours, _ROWS), "near", "kind")
    first = sorted((int.from_bytes(r.data, "little", signed=True), r.block) for r in near.where("kind = 'first'").select("block", "data").collect())
    starts, owners = np.array([x for x, _ in first], np.int64), np.array([x for _, x in first], np.int32)
    lists = near.where("kind in ('ids', 'sizes', 'near')")
    graph = cut(lists.groupBy("block").applyInArrow(lambda t: _begin(t, starts, owners), _ROWS), "graph", "kind")
    drop(near)
    fixed, now = graph.where("kind in ('offsets', 'local', 'heard_from', 'told', 'told_to')"), graph
    while heard := [r.block for r in now.where("kind = 'sent'").select("block").distinct().collect()]:
        awake = F.col("block").isin(heard)
        work = fixed.where(awake).unionByName(now.where(awake & F.col("kind").isin("own", "other", "sent")))
        new = work.groupBy("block").applyInArrow(_round, _ROWS).unionByName(now.where(~awake & F.col("kind").isin("own", "other")))
        new = cut(new, "cores", "kind")
        if now is not graph:
            drop(now)
        now = new
    last = graph.where("kind in ('ids', 'offsets', 'known')").unionByName(now.where("kind = 'own'"))
    return last.groupBy("block").applyInArrow(_numbers, "id long, core long")


def _table(block: int, rows: list[tuple[str, int, np.ndarray]]) -> pa.Table:
    return pa.Table.from_pylist([{"block": block, "kind": k, "peer": p, "data": a.tobytes()} for k, p, a in rows], _ARROW)


def _arrays(t: pa.Table) -> tuple[int, dict[str, bytes], list[tuple[int, np.ndarray]]]:
    """The block, its parts by kind, and what others have sent."""
    parts, sent = {}, []
    for kind, peer, data in zip(*(t[c].to_pylist() for c in ("kind", "peer", "data")), strict=True):
        if kind == "sent":
            sent.append((peer, np.frombuffer(data, np.int32)))
        else:
            parts[kind] = data
    return t["block"][0].as_py(), parts, sent


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block's ids, their numbers of neighbours, and the neighbours; a pair of equal ids says that a vertex exists."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got or not sum(len(a) for a, _ in got):
        return
    src, dst = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.ones(len(src), bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst = src[new], dst[new]
    ids, sizes = np.unique(src, return_counts=True)
    yield from _table(TaskContext.get().partitionId(), [("first", -1, ids[:1]), ("ids", -1, ids), ("sizes", -1, sizes.astype(np.int64)), ("near", -1, dst)]).to_batches()


def _begin(t: pa.Table, starts: np.ndarray, owners: np.ndarray) -> pa.Table:
    """Neighbours as places in the block's own numbers, followed by those of others; then the first round."""
    me, parts, _ = _arrays(t)
    ids, sizes, near = (np.frombuffer(parts[k], np.int64) for k in ("ids", "sizes", "near"))
    row = np.repeat(np.arange(len(ids)), sizes)
    known = np.zeros(len(ids), bool)
    known[row[ids[row] == near]] = True
    keep = ids[row] != near
    row, near = row[keep], near[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]).astype(np.int64)
    place = np.searchsorted(starts, near, "right") - 1
    away = owners[place] != me
    others = np.unique(near[away])
    local = np.where(away, len(ids) + np.searchsorted(others, near), np.searchsorted(ids, near)).astype(np.int32)
    heard_from = owners[np.searchsorted(starts, others, "right") - 1]  # ids ascend, and so do blocks: each has a range of places
    tell = np.unique(place[away] * len(ids) + row[away])
    told_to, told = owners[tell // len(ids)], (tell % len(ids)).astype(np.int32)
    own = np.where(known, np.diff(offsets), 0).astype(np.int32)
    est = np.concatenate([own, np.full(len(others), _UNHEARD, np.int32)])
    _settle(offsets, local, est, len(ids), np.flatnonzero(own))
    sent = _tell(me, told_to, told, np.full(len(ids), _UNHEARD), est)
    kept = [("ids", ids), ("known", known), ("offsets", offsets), ("local", local), ("heard_from", heard_from), ("told", told), ("told_to", told_to), ("own", est[: len(ids)]), ("other", est[len(ids) :])]
    return pa.concat_tables([_table(me, [(k, -1, a) for k, a in kept]), sent])


def _round(t: pa.Table) -> pa.Table:
    me, parts, sent = _arrays(t)
    offsets = np.frombuffer(parts["offsets"], np.int64)
    local, heard_from, told, told_to, own, other = (np.frombuffer(parts[k], np.int32) for k in ("local", "heard_from", "told", "told_to", "own", "other"))
    n, est, fell = len(own), np.concatenate([own, other]), np.zeros(len(own) + len(other), bool)
    begin = {int(p): int(i) for p, i in zip(*np.unique(heard_from, return_index=True), strict=True)}
    for peer, pairs in sent:
        at = n + begin[peer] + pairs[: len(pairs) // 2]
        est[at] = pairs[len(pairs) // 2 :]
        fell[at] = True
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    touched = np.zeros(n, bool)
    touched[row[fell[local] & (est[local] < est[row])]] = True
    _settle(offsets, local, est, n, np.flatnonzero(touched))
    return pa.concat_tables([_table(me, [("own", -1, est[:n]), ("other", -1, est[n:])]), _tell(me, told_to, told, own, est)])


def _tell(me: int, told_to: np.ndarray, told: np.ndarray, before: np.ndarray, est: np.ndarray) -> pa.Table:
    """To each block, places among the vertices it reads of this one and their numbers, where they have fallen."""
    out = []
    peers, begin = np.unique(told_to, return_index=True)
    for peer, mine in zip(peers, np.split(told, begin[1:]), strict=True) if len(peers) else ():
        at = np.flatnonzero(est[mine] < before[mine]).astype(np.int32)
        if len(at):
            out.append({"block": int(peer), "kind": "sent", "peer": me, "data": np.concatenate([at, est[mine[at]]]).tobytes()})
    return pa.Table.from_pylist(out, _ARROW)


def _rows(offsets: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vertices' neighbours, one vertex after the other, and where each begins."""
    n = offsets[v + 1] - offsets[v]
    begin = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(offsets[v] - begin, n), begin


def _settle(offsets: np.ndarray, local: np.ndarray, est: np.ndarray, n: int, todo: np.ndarray) -> None:
    """Lower the numbers of the first n to the h-index of their neighbours' numbers, until none changes; todo may have to fall."""
    todo = todo[est[todo] > 0]
    while len(todo):
        at, begin = _rows(offsets, todo)
        c = est[local[at]]
        low = np.add.reduceat(c >= np.repeat(est[todo], np.diff(np.append(begin, len(at)))), begin, dtype=np.int64) < est[todo]
        todo = todo[low]
        if not len(todo):
            return
        at, begin = _rows(offsets, todo)
        size = np.diff(np.append(begin, len(at)))
        seg = np.repeat(np.arange(len(todo)), size)
        near = local[at]
        c = np.minimum(est[near], np.repeat(est[todo], size)).astype(np.int64)
        key = np.sort((seg.astype(np.int64) << 32) - c)  # of each vertex, the greatest first
        c = (seg.astype(np.int64) << 32) - key
        h = np.add.reduceat(c > np.arange(len(c)) - np.repeat(begin, size), begin, dtype=np.int64)
        est[todo] = h
        near, fallen = near[near < n], np.repeat(h, size)[near < n]
        touched = np.zeros(n, bool)
        touched[near[est[near] > fallen]] = True
        todo = np.flatnonzero(touched)


def _numbers(t: pa.Table) -> pa.Table:
    """A vertex whose neighbours all are no vertices keeps their number."""
    _, parts, _ = _arrays(t)
    ids, known, own = np.frombuffer(parts["ids"], np.int64), np.frombuffer(parts["known"], bool), np.frombuffer(parts["own"], np.int32)
    core = np.where(own > 0, own, np.diff(np.frombuffer(parts["offsets"], np.int64)))
    return pa.table({"id": ids[known], "core": core[known].astype(np.int64)})
