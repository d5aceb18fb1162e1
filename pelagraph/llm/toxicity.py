"""Toxicity by a weighted finite-state pattern grammar.

Two levels of machines:

* *Characters.* Weighted arcs learned from labelled documents: whole words and stems (prefixes) with the lower
  confidence bound of their log odds between toxic and clean documents. A word takes its heaviest arc.
* *Words of a clause.* Small machines for insult, threat, target, negation and reported speech are composed
  into one deterministic machine over word classes. It reads a clause from its first word to its last, and a clause
  matches when an insult or a threat is read; what each adds depends on the state: little within three words of a
  negation, less after a verb of reporting, more where a target has been named, and a threat next to nothing without one.
  The sum is the matched clause's score.

An insult without target is a matched clause as well, an epithet, and counts in full (``UNAIMED``): toxic
documents of the tables hold epithets among other words and name no target, so that a grammar which asks for one
finds none of them. Features of a document are of its clauses only, none of a word.

A logistic curve over five features of a document's clauses turns them into the score. Training documents
are featurised without their own contribution to the arcs' counts, so they look like unseen ones.

The fit uses at most ``TRAIN_ROWS`` labelled documents (those with the smallest hash of the id), which is
what it broadcasts and sends; the arcs kept are at most ``ARCS``. Scoring covers every row and whole texts.

Defined results: null or empty text is scored as a text without clauses. Without both labels in training
every score is 0. Labels that disagree on a document count as toxic; null labels and ids teach nothing.
Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagraph.llm import common as c

TRAIN_ROWS, ARCS = 16_000, 50_000
MIN_TOXIC, MIN_WEIGHT, STEMS = 3, 0.7, (4, 5, 6, 7)
THRESHOLD = 0.7
#: An arc's weight lies so many standard errors below its estimate.
WIDTH = 1.0

# Words of the closed classes, in the four languages of the tables.
THREATS = "kill hurt destroy beat shoot stab die attack burn strangle töten verletzen zerstören sterben schlagen tuer blesser détruire mourir frapper matar herir destruir morir golpear".split()
TARGETS = "you your yours yourself u he she they them him her du dich dir dein ihr euch sie tu toi vous ton votre tú ti vosotros usted ustedes vuestro".split()
NEGATIONS = "not no never isn aren don doesn didn without nicht kein keine nie niemals ohne pas jamais sans nunca jamás sin tampoco".split()
REPORTS = "said says told claims claimed wrote quoted reported reports according alleged sagte sagt behauptet behauptete laut schrieb dit affirme affirmait selon écrit dijo dice según escribió afirma".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLOSED = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
_THREAT_WEIGHT = 2.0
#: Factors of an insult with and without a target before it, and of a threat without; of a negated and of a reported word.
AIMED_AT, UNAIMED, IDLE, DENIED, TOLD = 1.25, 1.0, 0.2, 0.4, 0.5

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")


# ---------------------------------------------------------------- clause machines
@dataclass(frozen=True)
class Machine:
    """A deterministic transducer over word classes: next state, and a factor for the weight read in a state."""

    start: int
    step: Callable[[int, int], int]
    factor: Callable[[int, int], float]


NEGATED = Machine(0, lambda s, k: 3 if k == NEGATION else max(0, s - 1), lambda s, k: DENIED if s else 1.0)
REPORTED = Machine(0, lambda s, k: 1 if k == REPORT else s, lambda s, k: TOLD if s else 1.0)
AIMED = Machine(0, lambda s, k: 1 if k == TARGET else s, lambda s, k: (AIMED_AT if s else UNAIMED) if k == INSULT else (1.0 if s else IDLE))
READS = Machine(0, lambda s, k: 0, lambda s, k: 1.0 if k in (INSULT, THREAT) else 0.0)


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[float]]]:
    """The product machine's tables: next state and factor by (state, class); state 0 is the start."""
    start = tuple(m.start for m in machines)
    at, todo, steps, factors = {start: 0}, [start], [], []
    for state in todo:
        row, gain = [], []
        for k in range(6):
            then = tuple(m.step(s, k) for m, s in zip(machines, state, strict=True))
            if then not in at:
                at[then] = len(at)
                todo.append(then)
            row.append(at[then])
            gain.append(math.prod(m.factor(s, k) for m, s in zip(machines, state, strict=True)))
        steps.append(row)
        factors.append(gain)
    return steps, factors


# ---------------------------------------------------------------- arcs
def arcs_of(word: str) -> list[str]:
    """The whole word, and its stems marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


@dataclass
class Model:
    arcs: dict[str, tuple[int, int]] = field(default_factory=dict)  # toxic and clean training documents with it
    toxic: int = 0
    clean: int = 0
    curve: list[float] = field(default_factory=list)  # logistic coefficients, the constant first

    def weight(self, arc: str, own: int | None = None) -> float:
        """own: the label of a training document, whose contribution is left out."""
        n1, n0 = self.arcs.get(arc, (0, 0))
        t, k = self.toxic, self.clean
        if own is not None:
            n1, t, n0, k = (n1 - 1, t - 1, n0, k) if own else (n1, t, max(0, n0 - 1), k - 1)
        if n1 < MIN_TOXIC:
            return 0.0
        w = math.log((n1 + 0.5) / (t + 1)) - math.log((n0 + 0.5) / (k + 1)) - WIDTH * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        return w if w >= MIN_WEIGHT else 0.0

    def read(self, word: str, own: int | None = None) -> tuple[int, float]:
        if k := _CLOSED.get(word):
            return k, _THREAT_WEIGHT if k == THREAT else 0.0
        w = max(self.weight(a, own) for a in arcs_of(word))
        return (INSULT, w) if w > 0 else (OTHER, 0.0)


class Reader(dict):
    """word -> (class, weight), remembered."""

    def __init__(self, model: Model, own: int | None = None):
        super().__init__()
        self.model, self.own = model, own

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = self.model.read(word, self.own)
        return found


GRAMMAR = compose(READS, NEGATED, REPORTED, AIMED)


def clause_score(read: list[tuple[int, float]], tokens: list[str]) -> tuple[float, float]:
    """(score, weight lost to context) of a clause, whose words the machine reads in turn. A word counts once."""
    steps, factors = GRAMMAR
    state, total, lost, seen = 0, 0.0, 0.0, set()
    for token, (k, w) in zip(tokens, read, strict=True):
        if w and token not in seen:
            seen.add(token)
            gain = w * factors[state][k]
            total += gain
            lost += max(0.0, w - gain) if k == INSULT else 0.0
        state = steps[state][k]
    return total, lost


def features(text: str | None, reader: Reader) -> list[float]:
    """Best clause, sum of clauses, sum for the length, matched clauses, weight lost to context (all but the third as logarithms)."""
    best = total = lost = 0.0
    matched = words = 0
    for clause in _CLAUSE.split((text or "").lower()):
        tokens = _WORD.findall(clause)
        words += len(tokens)
        read = [reader[w] for w in tokens]
        if not any(w for _, w in read):
            continue
        score, less = clause_score(read, tokens)
        best, total, lost, matched = max(best, score), total + score, lost + less, matched + 1
    return [math.log1p(best), math.log1p(total), total / math.sqrt(words + 20), math.log1p(matched), math.log1p(lost)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton's method with halved steps."""
    a = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.diag([1e-6, *np.ones(x.shape[1])])
    b = np.zeros(a.shape[1])
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (a @ v)).sum() + 0.5 * v @ penalty @ v
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(b)), a.T @ (p - y) + penalty @ b)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def score(x: list[float], curve: list[float]) -> float:
    z = curve[0] + sum(a * b for a, b in zip(curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def count_arcs(texts: list[str | None]) -> Counter:
    seen: Counter = Counter()
    for text in texts:
        words = set(_WORD.findall((text or "").lower()))
        seen.update({a for w in words for a in arcs_of(w)})
    return seen


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for y in (0, 1):
            n = count_arcs([t for t, k in zip(text, label, strict=True) if k == y])
            yield pa.RecordBatch.from_pydict({"arc": pa.array(n, pa.string()), "toxic": pa.array([v * y for v in n.values()], pa.int64()), "clean": pa.array([v * (1 - y) for v in n.values()], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """labels: doc_id and toxic; train: condition on the label's doc_id for use in training."""
    known = labels.where(train).where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_label"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # at most rows * 12 bytes: safe to broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    one = texts.join(F.broadcast(drawn), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # a repeated id counts once
    rows_ = c.keep(one.select("_label", "_text"), "labelled")
    sizes = {r["_label"]: r["count"] for r in rows_.groupBy("_label").count().collect()}
    model = Model(toxic=sizes.get(1, 0), clean=sizes.get(0, 0))
    if not model.toxic or not model.clean:
        return model
    n = c.map_arrow(rows_, _count, "arc string, toxic long, clean long").groupBy("arc").agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0"))
    rate = model.toxic / model.clean
    leaning = n.where(F.col("n1") >= MIN_TOXIC).where(F.col("n1") > 1.5 * rate * F.col("n0"))
    model.arcs = {r["arc"]: (r["n1"], r["n0"]) for r in leaning.orderBy(F.desc(F.col("n1") / (F.col("n0") * rate + 3)), "arc").limit(ARCS).collect()}
    held = docs.sparkSession.sparkContext.broadcast(model)

    #: Every arc of a training document holds its own contribution, so one reader a label serves all.
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {y: Reader(held.value, y) for y in (0, 1)}
        for batch in batches:
            label, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"y": pa.array(label, pa.int32()), "x": pa.array([features(t, readers[y]) for y, t in zip(label, text, strict=True)], pa.list_(pa.float64()))})

    got = c.map_arrow(rows_, featurise, "y int, x array<double>").collect()
    model.curve = logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)).tolist()
    return model


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, best_clause) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            x = [features(t, reader) for t in batch.column(1).to_pylist()]
            s = [score(v, held.value.curve) if held.value.curve else 0.0 for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32()), pa.array([math.expm1(v[0]) for v in x], pa.float64())], names=["doc_id", "score", "predicted", "best_clause"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return c.map_arrow(texts, run, "doc_id long, score double, predicted int, best_clause double")
