"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two documents link when
``100 * |x & y| >= 75 * |x | y|``; the result names each document's connected class.

How it runs, each step over all documents:

1. *Frequencies.* Each task sorts the shingle hashes it has seen into blobs by hash range; one task for a
   range counts them. The ``frequent`` most frequent shingles (a fixed bound, so safe to broadcast) get
   their count, all others count as rare. This gives one global order: (count, hash).
2. *Prefixes.* A partner of x shares at least ``o = ceil(0.75 |x|)`` of its shingles. Among the first
   ``|x| - o + m`` shingles of x, two linked documents share at least ``min(m_x, m_y)``. Each document takes
   the ``m`` of least estimated cost among 1, 2 and 4 times an eighth of its size: the entries of the prefix,
   and a verification for each of the ``sum / m`` partners that can share m prefix shingles, where sum adds
   up the prefix's counts. A prefix that has to hold frequent shingles is so lengthened, and asks for
   correspondingly more matches.
3. *Entries that meet.* Prefix entries meet by hash range, as blobs; those that meet another content stay. A
   document with fewer of them than any partner would ask for has no link and goes.
4. *Stars.* Each shingle names one centre, the content whose entries met the most. A document that shares enough
   with a centre is verified against the one it shares most with: one verification a document. The links found are
   contracted to classes, so a group of near copies, however large, has cost one verification a member.
5. *Pairs.* Shingles whose contents are of one class by now have done their work. Of the others, those in at most
   ``SMALL`` contents give their pairs over different classes; equal lists of contents (a shared passage) are one
   list with a weight. Pairs that share at least ``min(m_x, m_y)`` are verified, each against its own texts alone.
6. *Blocks.* Shingles in more contents than that only matter for documents that can reach their number of matches
   by such shingles. These are cut into blocks of a bounded number of documents and shingles by class; each two
   blocks, unless both are of one class, are one group, which counts shared prefix shingles and verifies.

Verification counts the whole intersection exactly. Exact copies are one content throughout; step 5 and 6 see a pair
in any class at most once, and links are kept as forests.

Defined results: null or empty text: n_shingles 0, alone. Fewer than five words: one shingle of the whole
sequence. Equal texts are one class. A repeated doc_id gives one result row for each row. A null doc_id
gives a null component_id and links with nothing. Only the two named columns are read, so extra columns of
any name do no harm. Hash collisions: shingles are compared by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pelagraph.llm import common as c
from pelagraph.operators.joins import beside_hubs

K = 5
#: Percent of the union.
THRESHOLD = 75
#: Shingles whose frequency is broadcast, at most (12 bytes each).
FREQUENT = 500_000
#: Seen in so few documents, a shingle counts as rare.
RARE = 3
#: A document asks for an eighth of its size as shared prefix shingles, or a multiple of that.
SHARE, MULTIPLES = 8, (1, 2, 4)
#: Verified shingles that cost as much as one prefix entry.
CHEAP = 16
#: Bounds of a block of candidates.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000
#: A shingle in more contents than this gives blocks instead of pairs.
SMALL = 32
#: Partners verified against one text in one group.
CHUNK = 256
#: Candidates (under 50 bytes each) that a join may broadcast.
BROADCAST_ROWS = 500_000
#: Hashes gathered in a task before they leave as blobs; bytes of text cut into words at once.
FLUSH, SLICE = 500_000, 1_000_000

_PART = "part int, kind int, doc_id long, key long, n int, a binary, b binary"
_PART_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _bits(parts: int) -> int:
    return max(6, min(20, int(np.ceil(np.log2(4 * parts)))))


def _overlap(n: int) -> int:
    """The least number of shared shingles with any linked partner."""
    return -(-THRESHOLD * n // 100)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], np.ndarray, list[np.ndarray]]]:
    memo = c.WordHash()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), c.as_bytes(batch.column(1))
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size > SLICE or i + 1 == len(texts):
                docs = [c.words_of(x) for x in texts[at : i + 1]]
                yield ids[at : i + 1], np.array([c.content_key(d) for d in docs], dtype=np.int64), c.shingle_sets(docs, memo, K)
                at, size = i + 1, 0


def _count_blobs(bits: int):
    """Meta rows (kind 0) and blobs of 32 bits below the part's bits (kind 1)."""

    def blobs(held: list[np.ndarray]) -> Iterator[tuple]:
        h = np.sort(np.concatenate(held)) if held else np.array([], np.uint64)
        low = (h >> np.uint64(32 - bits)).astype(np.uint32)
        for part, at in c.split_at((h >> np.uint64(64 - bits)).astype(np.int64)):
            yield part, 1, None, None, None, c.pack_sorted(low[at]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for ids, keys, sets in _sets(batches):
            deal = c.finish(np.array([i or 0 for i in ids], np.int64).view(np.uint64) + np.arange(len(ids), dtype=np.uint64)) >> np.uint64(64 - bits)
            rows: list[tuple] = [(p, 0, i, k, len(s), None, None) for p, i, k, s in zip(deal.astype(np.int64).tolist(), ids, keys.tolist(), sets, strict=True)]
            for k, s in zip(keys.tolist(), sets, strict=True):
                if len(s) and k not in seen:  # copies within a task count once
                    seen.add(k)
                    held.append(s)
                    size += len(s)
            if size > FLUSH:
                rows += blobs(held)
                held, size = [], 0
            yield c.emit(_PART_ARROW, rows)
        yield c.emit(_PART_ARROW, list(blobs(held)))

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meta rows pass; a part's blobs become its shingles seen more than RARE times (kind 2), and their numbers by frequency (kind 3)."""
    for part, rows in c.grouped(batches, "part"):
        out = [tuple(r[f] for f in _PART_ARROW.names) for r in rows if r["kind"] == 0]
        held = [c.unpack_sorted(r["a"]) for r in rows if r["kind"] == 1]
        if held:
            low, count = np.unique(np.concatenate(held), return_counts=True)
            low, count = low[count > RARE], count[count > RARE].astype(np.uint32)
            if len(low):
                out.append((part, 2, None, None, len(low), low.tobytes(), count.tobytes()))
        yield c.emit(_PART_ARROW, out)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many frequent shingles have each half-power of two as frequency."""
    total = np.zeros(128, np.int64)
    for batch in batches:
        for b in batch.column(0).to_pylist():
            total += np.bincount(_level(np.frombuffer(b, np.uint32)), minlength=128)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"level": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def _level(count: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(count, 1))).astype(np.int64)


def _frequent(found: DataFrame, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash prefixes, counts) of the most frequent shingles, at most ``most``; whole frequency levels only."""
    heavy = found.where("kind = 2")
    levels = {r["level"]: r["n"] for r in c.map_arrow(heavy.select("b"), _levels, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least, total = 128, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    floor = float(2 ** (least / 2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                count = np.frombuffer(b, np.uint32)
                ok = count >= floor - 1e-6
                if (ok := ok & (_level(count) >= least)).any():
                    high = (np.uint64(part) << np.uint64(32)) | np.frombuffer(a, np.uint32)[ok].astype(np.uint64)
                    yield pa.RecordBatch.from_pydict({"h": [high.tobytes()], "n": [count[ok].tobytes()]})

    rows = c.map_arrow(heavy.select("part", "a", "b"), cut, "h binary, n binary").collect() if least < 128 else []
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows]) if rows else np.array([], np.uint64)
    n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows]) if rows else np.array([], np.uint32)
    o = np.argsort(h)
    return h[o], n[o].astype(np.int64)


def prefix(shingles: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, int]:
    """The document's prefix in the order (frequency, hash), and the matches m that it asks for."""
    n, least = len(shingles), _overlap(len(shingles))
    ask = max(1, n // SHARE)
    rare = freq == 0
    if int(rare.sum()) >= n - least + ask:
        return shingles[rare][: n - least + ask], ask
    order = np.lexsort((shingles, freq))
    met = np.cumsum(freq[order])
    length = lambda m: n - least + m
    best = min((ask * x for x in MULTIPLES if x == 1 or ask * x <= least), key=lambda m: (length(m) + met[length(m) - 1] / m * n / CHEAP, m))
    return shingles[order[: length(best)]], best


def _frequencies(sets: list[np.ndarray], known: tuple[np.ndarray, np.ndarray], bits: int) -> list[np.ndarray]:
    if not sets:
        return []
    high, count = known
    flat = np.concatenate(sets) >> np.uint64(32 - bits)
    out = np.zeros(len(flat), np.int64)
    if len(high):
        at = np.minimum(np.searchsorted(high, flat), len(high) - 1)
        hit = high[at] == flat
        out[hit] = count[at[hit]]
    return np.split(out, np.cumsum([len(s) for s in sets])[:-1])


def _prefix_blobs(bits: int, known):
    def blobs(held: list[tuple[np.ndarray, int]]) -> Iterator[tuple]:
        if not held:
            return
        h = np.concatenate([x for x, _ in held])
        key = np.repeat(np.array([k for _, k in held], np.int64), [len(x) for x, _ in held])
        o = np.argsort(h, kind="stable")
        h, key = h[o], key[o]
        low = (h >> np.uint64(32 - bits)).astype(np.uint32)
        for part, at in c.split_at((h >> np.uint64(64 - bits)).astype(np.int64)):
            yield part, c.pack_sorted(low[at]), key[at].tobytes(), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("m", pa.int32())])
        seen: set[int] = set()
        held, size, rows = [], 0, []
        for _, keys, sets in _sets(batches):
            for k, s, f in zip(keys.tolist(), sets, _frequencies(sets, known.value, bits), strict=True):
                if len(s) and k not in seen:
                    seen.add(k)
                    p, m = prefix(s, f)
                    held.append((p, k))
                    rows.append((k & ((1 << bits) - 1), None, None, k, m))
                    size += len(p)
            if size > FLUSH:
                yield c.emit(schema, [*blobs(held), *rows])
                held, size, rows = [], 0, []
        yield c.emit(schema, [*blobs(held), *rows])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix entries (shingle, content) whose shingle is in several contents' prefixes; contents' m pass (without shingle)."""
    schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("m", pa.int32())])
    for part, rows in c.grouped(batches, "part"):
        asks = [(None, r["key"], r["m"]) for r in rows if r["a"] is None]
        if asks:
            yield c.emit(schema, asks)
        rows = [r for r in rows if r["a"] is not None]
        if not rows:
            continue
        low = np.concatenate([c.unpack_sorted(r["a"]) for r in rows])
        key = np.concatenate([np.frombuffer(r["b"], np.int64) for r in rows])
        o = np.lexsort((key, low))
        low, key = low[o], key[o]
        new = np.diff(low, prepend=~low[:1]) != 0
        fresh = new | (np.diff(key, prepend=~key[:1]) != 0)
        low, key, new = low[fresh], key[fresh], new[fresh]
        size = np.diff([*np.flatnonzero(new), len(low)])
        several = np.repeat(size > 1, size)
        token, key = (np.int64(part) << np.int64(32)) | low[several].astype(np.int64), key[several]
        for at in range(0, len(token), 100_000):
            n = len(token[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(token[at : at + n]), pa.array(key[at : at + n]), pa.nulls(n, pa.int32())], schema=schema)


def shared_counts(doc: np.ndarray, token: np.ndarray, m: int) -> np.ndarray:
    """m x m: how many tokens each two documents share. (doc, token) pairs are distinct."""
    o = np.argsort(token, kind="stable")
    doc, token = doc[o], token[o]
    start = np.flatnonzero(np.diff(token, prepend=~token[:1]))
    size = np.diff([*start, len(token)])
    out = np.zeros((m, m), np.int32)
    np.fill_diagonal(out, np.bincount(doc, minlength=m))
    for s in np.unique(size[(size > 1) & (size <= 32)]):
        docs = doc[start[size == s][:, None] + np.arange(s)]
        for i in range(s):
            for j in range(s):
                if i != j:
                    out += np.bincount(docs[:, i] * m + docs[:, j], minlength=m * m).reshape(m, m).astype(np.int32) if m <= 64 else 0
                    if m > 64:
                        np.add.at(out, (docs[:, i], docs[:, j]), 1)
    big = np.flatnonzero(size > 32)
    for at in range(0, len(big), 1024):
        held = np.zeros((m, min(1024, len(big) - at)), np.float32)
        for col, b in enumerate(big[at : at + 1024]):
            held[doc[start[b] : start[b] + size[b]], col] = 1
        more = (held @ held.T).astype(np.int32)
        np.fill_diagonal(more, 0)
        out += more
    return out


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)


def links(sets: list[np.ndarray], prefixes: list[np.ndarray], asked: np.ndarray, cross: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i < j) that link. cross: each document's side, if only pairs over both sides are wanted."""
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    ok = shared_counts(*_flat(prefixes), m) >= np.minimum(asked[:, None], asked[None, :])
    ok &= (100 * n[:, None] >= THRESHOLD * n[None, :]) & (100 * n[None, :] >= THRESHOLD * n[:, None])
    if cross is not None:
        ok &= cross[:, None] != cross[None, :]
    ok = np.triu(ok, 1)
    if not ok.any():
        return np.zeros((0, 2), np.int64)
    rows = np.flatnonzero(ok.any(0) | ok.any(1))
    inter = shared_counts(*_flat([sets[i] for i in rows]), len(rows)).astype(np.int64)
    size = n[rows]
    good = ok[np.ix_(rows, rows)] & (100 * inter >= THRESHOLD * (size[:, None] + size[None, :] - inter))
    return rows[np.argwhere(good)]


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(node, smallest node reached) of the nodes 0..n-1 that pairs join to a smaller one."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in range(n) if root(x) != x]


def _verify_blocks(group: pa.Table) -> pa.Table:
    names = ["key", "blk", "i", "j", "asked", "shingles", "prefix"]
    key, blk, i, j, asked, sets, pre = (group.column(x).to_pylist() for x in names)
    _, at = np.unique(np.array(key, np.int64), return_index=True)
    sets = [np.frombuffer(sets[x], np.uint64) for x in at]
    pre = [np.frombuffer(pre[x], np.uint64) for x in at]
    keys = np.array(key, np.int64)[at]
    side = np.array([blk[x] for x in at]) if i[0] != j[0] else None
    found = links(sets, pre, np.array(asked)[at], side) if len(at) > 1 else np.zeros((0, 2), np.int64)
    tree = _forest(found, len(at))
    return pa.table({"a": pa.array(keys[[x for x, _ in tree]], pa.int64()), "b": pa.array(keys[[y for _, y in tree]], pa.int64())})


def linked_to(anchor: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each other set links with the anchor's. All are sorted."""
    of, flat = _flat(others)
    at = np.minimum(np.searchsorted(anchor, flat), len(anchor) - 1)
    inter = np.bincount(of[anchor[at] == flat], minlength=len(others))
    size = np.array([len(x) for x in others], np.int64)
    return 100 * inter >= THRESHOLD * (len(anchor) + size - inter)


def _verify_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, anchor, key, shingles) sorted by grp -> the links (key, anchor)."""
    a, b = [], []
    for _, rows in c.grouped(batches, "grp"):
        own = {r["anchor"]: np.frombuffer(r["shingles"], np.uint64) for r in rows if r["anchor"] == r["key"]}
        for name, anchor in own.items():
            rest = [r for r in rows if r["anchor"] == name != r["key"]]
            if rest:
                good = linked_to(anchor, [np.frombuffer(r["shingles"], np.uint64) for r in rest])
                a += [r["key"] for r, g in zip(rest, good.tolist(), strict=True) if g]
                b += [name] * (len(a) - len(b))
        if len(a) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows stay within a fixed bound; else Catalyst shuffles both sides."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs: (doc_id, n_shingles, component_id); see the module's text."""
    return _classed(docs, id_col, text_col, frequent).select("doc_id", "n_shingles", "component_id")


class _Texts:
    """The named rows, and the sets of those contents that are asked for. alive: the candidates, a kept table.

    near marks a table of at most one row a candidate for broadcast, if the candidates are few enough.
    """

    def __init__(self, named: DataFrame, known, bits: int, parts: int, alive: DataFrame):
        self.named, self.known, self.bits, self.parts, self.alive = named, known, bits, parts, alive
        self.near = F.broadcast if alive.count() <= BROADCAST_ROWS else lambda df: df

    def sets(self, wanted: DataFrame, columns: list[str], prefixes: bool = False) -> DataFrame:
        """wanted: doc_id, key and columns, one row a key. Adds shingles; with prefixes also asked and prefix."""
        known, bits = self.known, self.bits

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row whose text is not the wanted content (a repeated doc_id) goes."""
            memo = c.WordHash()
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    docs = [c.words_of(x) for x in c.as_bytes(part.column(0))]
                    fits = [i for i, (d, k) in enumerate(zip(docs, part.column(1).to_pylist(), strict=True)) if c.content_key(d) == k]
                    sets = c.shingle_sets([docs[i] for i in fits], memo, K)
                    out = [*part.select(["key", *columns]).take(pa.array(fits, pa.int64())).columns, pa.array([s.tobytes() for s in sets], pa.binary())]
                    if prefixes:
                        pre = [prefix(s, f) for s, f in zip(sets, _frequencies(sets, known.value, bits), strict=True)]
                        out += [pa.array([m for _, m in pre], pa.int32()), pa.array([p.tobytes() for p, _ in pre], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, names=["key", *columns, "shingles", *(["asked", "prefix"] if prefixes else [])])

        rows = self.named.join(self.near(wanted), "doc_id").select("text", "key", *columns)
        schema = ", ".join(["key long", *(f"{x} {t}" for x, t in wanted.dtypes if x in columns), "shingles binary", *(["asked int", "prefix binary"] if prefixes else [])])
        return c.map_arrow(rows, fetch, schema)

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs: (a, b) of keys, distinct. The links among them, each verified on the whole sets (kept as table).

        The end of more pairs is the anchor, whose set meets its partners' in groups of at most CHUNK.
        """
        pairs = c.keep(pairs, name + "-pairs")
        degree = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").count()
        top = lambda x: degree.select(F.col("key").alias(x), F.col("count").alias("n" + x))
        both = pairs.join(self.near(top("a")), "a").join(self.near(top("b")), "b")
        turn = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        both = both.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("anchor"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("key"))
        cuts = both.groupBy("anchor").agg(F.count("*").alias("many")).join(self.near(self.alive.select(F.col("key").alias("anchor"), "n")), "anchor")
        cuts = cuts.select("anchor", F.greatest(F.ceil(F.col("many") / CHUNK), F.ceil(F.col("many") * F.col("n") / BLOCK_SHINGLES)).cast("int").alias("cuts"))
        own = cuts.select("anchor", F.col("anchor").alias("key"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
        side = both.join(self.near(cuts), "anchor").select("anchor", "key", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int").alias("cut"))
        side = c.keep(side.unionByName(own).withColumn("grp", F.xxhash64("anchor", "cut")).drop("cut"), name + "-sides")
        wanted = self.alive.join(self.near(side.select("key").distinct()), "key", "left_semi").select("doc_id", "key")
        met = self.sets(wanted, []).join(_small(side), "key").select("grp", "anchor", "key", "shingles")
        met = met.repartition(self.parts, "grp").sortWithinPartitions("grp")
        return c.keep(c.map_arrow(met, _verify_anchors, "a long, b long"), name)


def star_pairs(post: DataFrame, facts: _Texts) -> DataFrame:
    """(a, b): each content and the centre that it shares most with, where that is enough. post: token, key, rank."""
    alive, near = facts.alive, facts.near
    centres = c.keep(post.groupBy("token").agg(F.min_by("key", "rank").alias("centre"), F.count("*").alias("many")).where("many > 1"), "centres")
    met = beside_hubs(post.drop("rank"), centres, "token", "many", post.count()).where("key != centre").groupBy("key", "centre").agg(F.count("*").alias("same"))
    mine, other = alive.select("key", "n", "m"), alive.select(F.col("key").alias("centre"), F.col("n").alias("cn"), F.col("m").alias("cm"))
    fits = met.join(near(mine), "key").join(near(other), "centre").where("same >= least(m, cm)").where(_sizes("n", "cn"))
    order = F.col("same") * (1 << 40) + F.col("centre").bitwiseAND(F.lit((1 << 40) - 1))
    return fits.groupBy("key").agg(F.max_by("centre", order).alias("b")).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def _sizes(x: str, y: str) -> str:
    return f"100 * {x} >= {THRESHOLD} * {y} and 100 * {y} >= {THRESHOLD} * {x}"


def list_pairs(post: DataFrame, facts: _Texts, wide: DataFrame) -> DataFrame:
    """(a, b): contents of different classes that share enough shingles of few contents.

    post: token, key, cls, of tokens in at most SMALL contents. wide: key, big, the number of a content's other live tokens.
    """
    lists = post.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("key", "cls"))).alias("of")).groupBy("of").agg(F.count("*").alias("w"))
    each = F.expr("explode(flatten(transform(of, (x, i) -> transform(filter(slice(of, i + 2, size(of)), y -> y.cls != x.cls), y -> struct(x.key AS a, y.key AS b)))))")
    met = lists.select("w", each.alias("p")).groupBy("p.a", "p.b").agg(F.sum("w").alias("same"))
    rows = facts.alive.join(facts.near(wide), "key", "left").select("key", "n", "m", F.coalesce("big", F.lit(0)).alias("big"))
    side = lambda x: facts.near(rows.select(F.col("key").alias(x), *(F.col(y).alias(x + y) for y in ("n", "m", "big"))))
    return met.join(side("a"), "a").join(side("b"), "b").where("same + least(abig, bbig) >= least(am, bm)").where(_sizes("an", "bn")).select("a", "b")


def _classed(docs: DataFrame, id_col: str, text_col: str, frequent: int) -> DataFrame:
    """jaccard_components with each row's content key and class (null where it links with nothing by definition)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = c.width(texts)
    bits = _bits(parts)
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")

    found = c.keep(c.map_arrow(by_part(c.map_arrow(texts, _count_blobs(bits), _PART)), _count, _PART), "counts")
    meta = found.where("kind = 0").select("doc_id", "key", "n")
    known = spark.sparkContext.broadcast(_frequent(found, bits, frequent))

    named = texts.where("doc_id is not null")
    entries = by_part(c.map_arrow(named, _prefix_blobs(bits, known), "part int, a binary, b binary, key long, m int"))
    post = c.keep(c.map_arrow(entries, _shared, "token long, key long, m int"), "entries")
    asks = post.where("token is null").groupBy("key").agg(F.max("m").alias("m"))
    post = post.where("token is not null").drop("m")

    contents = meta.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    #: No partner is smaller than the overlap, so none asks for less than its share of that.
    asked = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * THRESHOLD / 100) / SHARE))
    alive = contents.join(post.groupBy("key").agg(F.count("*").alias("met")), "key").withColumn("asked", asked).where("met >= asked").join(asks, "key")
    alive = c.keep(alive, "alive")
    facts = _Texts(named, known, bits, parts, alive)

    #: The share of a content's shingles that met others, the greatest first; then the key.
    rank = F.floor((1 - F.col("met") / F.greatest("n", "met")) * 1023).cast("long") * (1 << 52) + F.col("key").bitwiseAND(F.lit((1 << 52) - 1))
    post = c.keep(post.join(facts.near(alive.select("key", rank.alias("rank"))), "key"), "alive-entries")
    stars = facts.linked(star_pairs(post, facts), "stars")
    tied = c.components(stars, "a", "b")

    post = post.join(facts.near(tied), F.col("key") == F.col("node"), "left").select("token", "key", F.coalesce("label", "key").alias("cls"))
    live = post.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("many")).where("lo != hi").select("token", "many")
    live = c.keep(live, "live-tokens")
    live = c.keep(beside_hubs(post, live, "token", "many", live.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]), "live")
    wide = c.keep(live.where(F.col("many") > SMALL).groupBy("key").agg(F.count("*").alias("big")), "wide")
    linked = facts.linked(list_pairs(live.where(F.col("many") <= SMALL), facts, wide), "linked")
    linked = linked.unionByName(stars)
    dense = alive.join(facts.near(wide), "key").where("big >= asked")
    if dense.take(1):
        linked = linked.unionByName(_dense(live.where(F.col("many") > SMALL), dense, facts))
    classes = c.components(linked, "a", "b")

    classes = facts.near(classes)
    rows = meta.join(classes, meta["key"] == classes["node"], "left").select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "key").alias("cls"))
    least = rows.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
    least = _small(c.keep(least, "least"))  # a class may hold a third of all rows; its one row here goes to them
    on = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("cls"))
    return rows.withColumn("cls", on).join(least, "cls", "left").select("doc_id", "key", "cls", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _dense(post: DataFrame, dense: DataFrame, facts: _Texts) -> DataFrame:
    """Links among contents that share enough shingles of many contents. post: token, key, cls of those shingles.

    The contents that such shingles tie are cut into blocks. A class of more than a block's documents has blocks of
    its own, which need not meet each other; the other classes share blocks by a hash of the class.
    """
    post = c.keep(post.select("token", "key", "cls").join(facts.near(dense.select("key")), "key", "left_semi"), "dense-entries")
    centres = c.keep(post.groupBy("token").agg(F.min("key").alias("centre"), F.count("*").alias("many")), "dense-centres")
    comps = c.components(beside_hubs(post, centres, "token", "many", post.count()).where("key != centre").select("key", "centre").distinct(), "key", "centre")
    rows = dense.join(post.select("key", "cls").distinct(), "key").join(comps.select(F.col("node").alias("key"), F.col("label").alias("comp")), "key")
    rows = c.keep(rows.select("key", "doc_id", "n", "cls", "comp"), "dense")
    cuts = F.greatest(F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    own = rows.groupBy("comp", "cls").agg(cuts.alias("own")).where("own > 1")
    rows = rows.join(facts.near(own), ["comp", "cls"], "left")
    rest = rows.where("own is null").groupBy("comp").agg(cuts.alias("rest"))
    rows = rows.join(facts.near(rest), "comp", "left")
    blk = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("cls"), F.col("rest"))).otherwise(F.xxhash64("cls", F.pmod(F.xxhash64("key"), F.col("own"))))
    rows = c.keep(rows.select("key", "doc_id", "comp", blk.alias("blk"), F.when(F.col("own").isNotNull(), F.col("cls")).alias("whole")), "blocks")
    blocks = rows.groupBy("comp", "blk").agg(F.max("whole").alias("whole"))
    met = blocks.select("comp", F.col("blk").alias("i"), F.col("whole").alias("iw")).join(blocks.select("comp", F.col("blk").alias("j"), F.col("whole").alias("jw")), "comp")
    met = c.keep(met.where("i <= j and not (iw is not null and iw <=> jw)").select("comp", "i", "j"), "meetings")
    seats = met.select("comp", "i", "j", F.col("i").alias("blk")).unionByName(met.select("comp", "i", "j", F.col("j").alias("blk"))).distinct()
    sets = facts.sets(rows.drop("whole"), ["comp", "blk"], prefixes=True)
    groups = sets.join(_small(seats), ["comp", "blk"])
    return c.keep(groups.groupBy("comp", "i", "j").applyInArrow(_verify_blocks, "a long, b long"), "dense-links")


def _keyed(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """docs with the content key of each row's text as column key."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [c.content_key(c.words_of(x)) for x in c.as_bytes(batch.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, key])

    return c.map_arrow(docs, run, StructType([*docs.schema.fields, StructField(key, LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, one of each class: that with the smallest (doc_id, content key).

    Rows without doc_id stay (they link with nothing). Of rows with the same doc_id and the same words, or both without
    any, the one whose JSON sorts first stays. Rows that share an id only are judged each by its own class.
    """
    id_, gone, again_, stay_, key, nth = c.fresh(docs, "id", "gone", "again", "stay", "key", "nth")
    mine = F.col(f"`{id_col}`").cast("long")
    found = c.keep(_classed(docs, id_col, text_col, FREQUENT), "classes").where("doc_id is not null")
    ids = c.keep(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("many")), "ids")
    later = ids.where("not first").select(F.col("doc_id").alias(gone))
    rows = docs.join(_small(later), mine == F.col(gone), "left_anti")
    again = ids.where("many > 1 and first").select(F.col("doc_id").alias(again_))
    if not again.take(1):  # no id repeats among those that stay
        return rows
    again = _small(again)
    stay = found.where("doc_id = component_id").join(again, F.col("doc_id") == F.col(again_), "left_semi")
    stay = stay.groupBy("doc_id", "cls").agg(F.min("key").alias(stay_)).select(F.col("doc_id").alias(id_), stay_).distinct()
    same = mine == F.col(again_)
    several = _keyed(rows.join(again, same, "left_semi"), text_col, key)
    several = several.join(stay, (mine == F.col(id_)) & (F.col(key) == F.col(stay_)), "left_semi")
    order = Window.partitionBy(mine, key).orderBy(F.to_json(F.struct(*(F.col(f"`{x}`") for x in docs.columns))))
    several = several.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth, key)
    return rows.join(again, same, "left_anti").unionByName(several)
