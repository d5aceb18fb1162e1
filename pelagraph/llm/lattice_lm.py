"""Language-model scoring by subword lattice likelihood, beside a plain word model.

A word is a path through a lattice: its arcs are the pieces of an existing vocabulary file, weighted by that file's
scores, and one arc for the whole word, weighted by the word's count in the training documents. The probability
sums over all paths.

* *Pieces.* The file's scores are ranks, from 0 down; a piece of score -r weighs ``1 / (r + SHIFT)`` (Zipf's law), all
  weights sum to 1. A word's first piece starts with the space mark and no other does, so the sums over all
  segmentations (forward recursion in logarithms) are a distribution over words. A character without piece is
  spelled in the vocabulary's byte pieces, which weigh as the last rank does.
* *Whole words.* The pieces' share is that of words seen once, ``(singles + 1) / (words + 2)`` (Good and Turing's
  estimate of what is new); the rest is shared by the whole words, as their counts are.
* *Documents.* After each word the document ends with the probability ``(ends + 1) / (tokens + 2)``; its probability is the
  product over its words and its end.

So what is learned is the whole training corpus' table of word counts, which grows with it; unseen words still get
what their pieces say. The base model is a word unigram with add-one smoothing: ``sum log10((c + 1) / (N + V + 1))`` over
words and end.

How the corpus's word counts reach the documents: one pass counts words by hash range, as blobs. The most
frequent words (a fixed bound) are broadcast with their counts; for the rest, each task sends (word hash,
document, occurrences, pieces' log probability) to the hash range, where the training occurrences are summed, and the
range answers with each document's sums of logarithms; answers meet the task's documents again and are added up.

Defined results: null text is empty text: the end alone. A null id is not held out and teaches nothing.
Nothing to learn from: N and V are 0. Repeated rows count and are scored each. Words are told apart by
64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagraph.llm import common as c

#: Words whose count is broadcast, at most (16 bytes each), and the count from which a word can be one.
HEAD, COMMON = 400_000, 3
#: Distinct words, and documents' rare words, gathered in a task before they leave as blobs.
FLUSH_WORDS, FLUSH_RARE = 120_000, 600_000
#: Scored words that a task remembers before it starts over.
MEMO_WORDS = 600_000
_SPACE = "▁"
#: Added to a piece's rank: its weight is the inverse of the sum.
SHIFT = 3.0
LOG10 = math.log(10)


# ---------------------------------------------------------------- vocabulary and lattice
class Vocabulary:
    """The pieces of a model file and their log probabilities, read on the machine that uses them."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        ids = range(sp.get_piece_size())
        plain = {sp.id_to_piece(i): -sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        plain = {p: r for p, r in plain.items() if _SPACE not in p[1:]}
        last = max(plain.values(), default=0.0)
        bytes_ = [int(sp.id_to_piece(i)[3:5], 16) for i in ids if sp.is_byte(i)]
        total = math.log(sum(1 / (r + SHIFT) for r in plain.values()) + len(bytes_) / (last + SHIFT))
        self.pieces = {p: -math.log(r + SHIFT) - total for p, r in plain.items()}
        self.bytes = {b: -math.log(last + SHIFT) - total for b in bytes_}


class Lattice:
    """log p of pieces -> log probability of a word over all segmentations.

    The pieces are a trie of dictionaries; the entry '' of a node is the log p of the piece that ends there.
    """

    def __init__(self, pieces: dict[str, float], bytes_: dict[int, float]):
        self.log_p = pieces
        self.byte = [bytes_.get(b, min(pieces.values())) for b in range(256)]
        self.trie: dict = {}
        for piece, p in pieces.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = p

    def word(self, word: str) -> float:
        s, trie = _SPACE + word, self.trie
        n = len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            x = into[i]
            alpha = x[0] if len(x) == 1 else _log_sum(x)
            node = trie.get(s[i])
            if node is None or "" not in node:
                into[i + 1].append(alpha + sum([self.byte[b] for b in s[i].encode("utf-8", "replace")]))
            j = i + 1
            while node is not None:
                p = node.get("")
                if p is not None:
                    into[j].append(alpha + p)
                if j == n:
                    break
                node = node.get(s[j])
                j += 1
        return _log_sum(into[n])


def _log_sum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum([math.exp(v - m) for v in x]))


# ---------------------------------------------------------------- counting
_COUNTED = "part int, kind int, n long, a binary, b binary"
_COUNTED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unzip(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _count_words(parts: int):
    """Training rows -> word counts by part (kind 0) and the task's number of documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, words, docs = c.WordHash(), Counter(), 0

        def flush() -> pa.RecordBatch:
            h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
            n = np.fromiter(words.values(), np.uint32, len(words))
            o = np.argsort(h)
            h, n = h[o], n[o]
            return c.emit(_COUNTED_ARROW, [(p, 0, None, _zip(h[at]), _zip(n[at])) for p, at in c.split_at(_part(h, parts))])

        for batch in batches:
            docs += batch.num_rows
            for t in c.as_bytes(batch.column(0)):
                words.update(c.words_of(t))
            if len(words) > FLUSH_WORDS:
                yield flush()
                words.clear()
        yield flush()
        yield c.emit(_COUNTED_ARROW, [(docs % parts, 1, docs, None, None)])

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's counts: its common words (kind 2), distinct words (3), occurrences (4) and words seen once (5); documents pass (1)."""
    for part, rows in c.grouped(batches, "part"):
        out: list[tuple] = []
        if held := [r for r in rows if r["kind"] == 0]:
            h, at = np.unique(np.concatenate([_unzip(r["a"], np.uint64) for r in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([_unzip(r["b"], np.uint32) for r in held]).astype(np.float64)).astype(np.int64)
            common = n >= COMMON
            out += [(part, 2, int(common.sum()), _zip(h[common]), _zip(n[common])), (part, 3, len(h), None, None), (part, 4, int(n.sum()), None, None), (part, 5, int((n == 1).sum()), None, None)]
        out += [(part, 1, r["n"], None, None) for r in rows if r["kind"] == 1]
        yield c.emit(_COUNTED_ARROW, out)


class Model:
    """What the corpus taught: its words, ends, distinct words, words seen once, and the most frequent words' counts."""

    def __init__(self, words: int, ends: int, distinct: int, singles: int, head: np.ndarray, head_n: np.ndarray):
        self.words, self.ends, self.head, self.head_n = words, ends, head, head_n
        self.tokens, self.distinct = words + ends, distinct + (ends > 0)
        self.end_p = (ends + 1) / (self.tokens + 2)
        self.pieces_share = (singles + 1) / (words + 2)

    def word(self, pieces: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of words by their pieces' log probability and their counts."""
        with np.errstate(divide="ignore"):
            whole = np.log(n * ((1 - self.pieces_share) / max(1, self.words)))
        return (np.logaddexp(math.log(self.pieces_share) + pieces, whole) + math.log1p(-self.end_p)) / LOG10


def _level(n: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(n)).astype(np.int64)


def fit(docs: DataFrame, text_col: str = "text", head: int = HEAD) -> Model:
    """docs: the training rows."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    parts = c.width(texts)
    dealt = c.map_arrow(texts, _count_words(parts), _COUNTED).repartition(parts, "part").sortWithinPartitions("part")
    found = c.keep(c.map_arrow(dealt, _sum_words, _COUNTED), "words")
    sums = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total += np.bincount(_level(_unzip(b, np.int64)), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    by_level = {r["level"]: r["n"] for r in c.map_arrow(found.where("kind = 2").select("b"), levels, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least, total = 256, 0
    for level in sorted(by_level, reverse=True):
        if (total := total + by_level[level]) > head:
            break
        least = level

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = _unzip(b, np.int64)
                ok = _level(n) >= least
                yield pa.RecordBatch.from_pydict({"h": [_unzip(a, np.uint64)[ok].tobytes()], "n": [n[ok].tobytes()]})

    rows = c.map_arrow(found.where("kind = 2").select("a", "b"), cut, "h binary, n binary").collect()
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows] or [np.array([], np.uint64)])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows] or [np.array([], np.int64)])
    o = np.argsort(h)
    got = lambda kind: int(sums.get(kind) or 0)
    return Model(got(4), got(1), got(3), got(5), h[o], n[o])


# ---------------------------------------------------------------- scoring
_ROUTED = "part int, origin long, kind int, a binary, b binary, c binary, d binary, e binary"
_ROUTED_ARROW = pa.schema([("part", pa.int32()), ("origin", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde")])


class _Words(dict):
    """word -> index into the arrays of hash, pieces' log probability, count (-1: not in the head) and, of the head's, log10 probability.

    New words are only noted; settle() adds them to the arrays, all at once.
    """

    def __init__(self, model: Model, lattice: Lattice):
        super().__init__()
        self.model, self.lattice = model, lattice
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.h, self.p, self.n, self.whole = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        self.new_h: list[int] = []
        self.new_p: list[float] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new_h.append(c.xxhash.xxh3_64_intdigest(word))
        self.new_p.append(self.lattice.word(word.decode("utf-8", "replace")))
        return i

    def settle(self) -> None:
        h = np.array(self.new_h, np.uint64)
        n = np.full(len(h), -1, np.int64)
        if len(self.model.head):
            at = np.minimum(np.searchsorted(self.model.head, h), len(self.model.head) - 1)
            n = np.where(self.model.head[at] == h, self.model.head_n[at], -1)
        p = np.array(self.new_p, np.float64)
        self.h, self.n, self.p = np.concatenate([self.h, h]), np.concatenate([self.n, n]), np.concatenate([self.p, p])
        self.whole = np.concatenate([self.whole, np.where(n >= 0, self.model.word(p, np.maximum(n, 0)), 0.0)])
        self.new_h, self.new_p = [], []


def _score_docs(parts: int, held, vocabulary: str | None):
    """Documents -> one header a flush (kind 0) and requests for their rare words (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, v = held.value, Vocabulary(vocabulary)
        words = _Words(model, Lattice(v.pieces, v.bytes))
        end_p, end_n = math.log10(model.end_p), model.ends
        context = TaskContext.get()
        origin = (context.partitionId() if context else 0) << 32
        head: list[tuple] = []
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal origin
            origin += 1
            ids, out, n, known, base, score = zip(*head, strict=True) if head else ([],) * 6
            rows: list[tuple] = [(origin % parts, origin, 0, zstandard.compress(np.array([i is None for i in ids], bool).tobytes() + np.array([i or 0 for i in ids], np.int64).tobytes(), 1), _zip(np.array(out, bool)), _zip(np.array([n, known], np.int64)), _zip(np.array(base, float)), _zip(np.array(score, float)))] if head else []
            if rare:
                h = np.concatenate([x for x, *_ in rare])
                times = np.concatenate([x for _, x, *_ in rare])
                pieces = np.concatenate([x for _, _, x, *_ in rare])
                doc = np.repeat(np.array([d for *_, d, _ in rare], np.uint32), [len(x) for x, *_ in rare])
                taught = np.repeat(np.array([t for *_, t in rare], bool), [len(x) for x, *_ in rare])
                o = np.argsort(h, kind="stable")
                part = _part(h[o], parts)
                for p, at in c.split_at(part):
                    q = o[at]
                    rows.append((p, origin, 1, _zip(h[q]), _zip(times[q].astype(np.uint16) if times[q].max() < 65536 else times[q].astype(np.uint32)), _zip(doc[q]), _zip(taught[q]), bytes([2 if times[q].max() < 65536 else 4]) + pieces[q].tobytes()))
            head.clear()
            rare.clear()
            return c.emit(_ROUTED_ARROW, rows)

        for batch in batches:
            if len(words) > MEMO_WORDS:
                words.clear()
            texts = [c.words_of(t) for t in c.as_bytes(batch.column(3))]
            flat = np.fromiter((words[w] for t in texts for w in t), np.int64, sum(map(len, texts)))
            words.settle()
            lo = 0
            for doc_id, out, taught, tokens in zip(*(batch.column(i).to_pylist() for i in range(3)), texts, strict=True):
                at = flat[lo : lo + len(tokens)]
                lo += len(tokens)
                n = words.n[at]
                tail = n < 0
                base = np.log10(n[~tail] + 1.0).sum() + math.log10(end_n + 1)
                head.append((doc_id, out, len(tokens) + 1, int((~tail).sum()) + (end_n > 0), float(base), float(words.whole[at].sum()) + end_p))
                if tail.any():
                    h, first, times = np.unique(words.h[at[tail]], return_index=True, return_counts=True)
                    rare.append((h, times.astype(np.uint32), words.p[at[tail][first]], len(head) - 1, bool(taught)))
                    size += len(h)
            if size > FLUSH_RARE or len(head) > 50_000:
                yield flush()
                size = 0
        yield flush()

    return run


def _answer(held):
    """Headers pass. A part's requests become, for each origin, (document, sum of log10(c + 1), known, sum of log10 p) (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answers(batches, held.value)

    return run


def _answers(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part, rows in c.grouped(batches, "part"):
        out = [tuple(r[f] for f in _ROUTED_ARROW.names) for r in rows if r["kind"] == 0]
        asked = [r for r in rows if r["kind"] == 1]
        if asked:
            hs = [_unzip(r["a"], np.uint64) for r in asked]
            times = [_unzip(r["b"], np.uint16 if r["e"][0] == 2 else np.uint32).astype(np.int64) for r in asked]
            taught = [_unzip(r["d"], bool) for r in asked]
            _, at = np.unique(np.concatenate(hs), return_inverse=True)
            n = np.bincount(at, np.concatenate(times) * np.concatenate(taught)).astype(np.int64)
            log, lo = np.log10(n + 1.0), 0
            word = model.word(np.concatenate([np.frombuffer(r["e"], np.float64, offset=1) for r in asked]), n[at])
            for r, t in zip(asked, times, strict=True):
                mine, of_word = at[lo : lo + len(t)], word[lo : lo + len(t)]
                lo += len(t)
                docs, of = np.unique(_unzip(r["c"], np.uint32), return_inverse=True)
                out.append((part, r["origin"], 2, _zip(docs), _zip(np.bincount(of, t * log[mine])), _zip(np.bincount(of, t * (n[mine] > 0)).astype(np.uint32)), _zip(np.bincount(of, t * of_word)), None))
        yield c.emit(_ROUTED_ARROW, out)


def _combine(tokens: int, distinct: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in c.grouped(batches, "origin"):
            top = next(r for r in rows if r["kind"] == 0)
            raw = zstandard.decompress(top["a"])
            n, known = _unzip(top["c"], np.int64).reshape(2, -1).copy()
            none, ids = np.frombuffer(raw[: len(n)], bool), np.frombuffer(raw[len(n) :], np.int64)
            base, score = _unzip(top["d"], float).copy(), _unzip(top["e"], float).copy()
            for r in sorted((r for r in rows if r["kind"] == 2), key=lambda r: r["part"]):
                docs = _unzip(r["a"], np.uint32)
                base[docs] += _unzip(r["b"], float)
                known[docs] += _unzip(r["c"], np.uint32)
                score[docs] += _unzip(r["d"], float)
            base -= n * math.log10(tokens + distinct + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none), pa.array(_unzip(top["b"], bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, held_out: Column, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, head: int = HEAD) -> DataFrame:
    """held_out, train: conditions over docs. One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    taught = F.coalesce(train, F.lit(False))
    model = fit(docs.where(taught), text_col, head)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), taught.alias("taught"), F.col(text_col).cast("string").alias("text"))
    parts = c.width(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    asked = c.map_arrow(rows, _score_docs(parts, held, vocabulary), _ROUTED).repartition(parts, "part").sortWithinPartitions("part")
    answers = c.map_arrow(asked, _answer(held), _ROUTED).repartition(parts, "origin").sortWithinPartitions("origin")
    return c.map_arrow(answers, _combine(model.tokens, model.distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
