"""Language identification by compression.

Fit: for each language a raw-content zstandard dictionary, built from excerpts of a bounded sample of its
labelled documents (``DICT_BYTES`` bytes); every language is learned. Languages are fitted, and texts scored, in
groups of ``GROUP`` languages: no more excerpts come to the driver at once, nor compressors stand in a worker.
Predict: a whole text, lower-cased and with all but letters turned to single blanks, is cut into blocks;
each block (and a fixed tail) is compressed with each dictionary, and the language with the smallest total is chosen. The
margin is the runner-up's excess relative to it. A text is rejected when the margin is under ``MARGIN``.

Defined results: null text or no letter: ``und``, score 0, rejected. Equal totals: the language that sorts
first, score 0. One learned language only: it, score 1. Nothing to learn from: ``und``, score 0, rejected.
Rows with null lang, null text or null id teach nothing; a null id is not held out. Repeated rows are
predicted each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagraph.llm import common as c

UNDETERMINED = "und"
#: Bounds of the fit: bytes of a dictionary, characters of an excerpt; languages handled at once.
DICT_BYTES, EXCERPT, GROUP = 65_536, 512, 128
#: Bytes compressed at once, and zstandard's level.
BLOCK, LEVEL = 4096, 6
#: Follows each block: a block that does not shrink would be stored raw, whatever the dictionary matched in it.
PAD = b"\0" * 64
#: Relative margins: rejected below the first; scored one half at the second.
MARGIN, HALF = 0.002, 0.02

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text; empty if it has no letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return out.encode("utf-8", "replace") if any(map(str.isalpha, out)) else b""


class Model:
    """dictionaries: language -> raw content."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.dictionaries, self.level, self.block = dict(sorted(dictionaries.items())), level, block

    def compressors(self, names: list[str] | None = None) -> list[zstandard.ZstdCompressor]:
        """One for each of the given languages; of all if None."""
        out = []
        for name in self.dictionaries if names is None else names:
            d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def _blocks(self, text: str | None) -> list[bytes]:
        data = letters(text) if text else b""
        data = b" " + data + b" " if data else b""
        return [data[i : i + self.block] + PAD for i in range(0, len(data), self.block)]

    def predict(self, texts: list[str | None], compressors: list[zstandard.ZstdCompressor] | None = None) -> list[tuple[str, float, float]]:
        """(language, score, margin) of each text. compressors: of all languages; None: made and dropped by groups."""
        names, out = list(self.dictionaries), []
        blocks = [self._blocks(text) for text in texts]
        totals = np.zeros((len(texts), len(names)))
        step = GROUP if compressors is None else max(1, len(names))
        for at in range(0, len(names), step):
            group = self.compressors(names[at : at + step]) if compressors is None else compressors
            for i, held in enumerate(blocks):
                if held:
                    totals[i, at : at + step] = [sum(len(z.compress(b)) for b in held) for z in group]
        for held, total in zip(blocks, totals, strict=True):
            if not held or not names:
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            best = int(total.argmin())
            if len(names) == 1:
                out.append((names[0], 1.0, 1.0))
                continue
            second = float(np.delete(total, best).min())
            margin = (second - total[best]) / second
            out.append((names[best], margin / (margin + HALF), margin))
        return out


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES) -> Model:
    """Learn from the rows where train holds. About 4 * dict_bytes of excerpts a language come to the driver, GROUP languages at once."""
    rows = docs.where(train).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    found, names = {}, sorted(counts)
    for i in range(0, len(names), GROUP):
        found |= _excerpts(rows, {k: counts[k] for k in names[i : i + GROUP]}, dict_bytes)
    return Model(found)


def _excerpts(rows: DataFrame, counts: dict[str, int], dict_bytes: int) -> dict[str, bytes]:
    """The dictionaries of the languages that counts names."""
    wanted = 4 * dict_bytes // EXCERPT  # excerpts may be short
    rate = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, wanted / n)))))
    drawn = F.pmod(F.xxhash64("i", "t", F.lit("draw")), F.lit(1 << 30)) < rate[F.col("l")] * (1 << 30)
    at = F.pmod(F.xxhash64("i", F.lit("at")), F.greatest(F.length("t") - EXCERPT + 1, F.lit(1))) + 1
    sample = rows.where(F.col("l").isin(list(counts))).where(drawn).select("l", F.xxhash64("i", F.lit("order")).alias("o"), F.substr("t", at.cast("int"), F.lit(EXCERPT)).alias("x"))
    held: dict[str, list[tuple[int, str]]] = {}
    for r in sample.distinct().collect():  # repeated rows count once
        held.setdefault(r["l"], []).append((r["o"], r["x"]))
    return {k: b" ".join(map(letters, (x for _, x in sorted(v))))[:dict_bytes] or b" " for k, v in held.items()}


def _ready(model: Model) -> list[zstandard.ZstdCompressor] | None:
    return model.compressors() if len(model.dictionaries) <= GROUP else None


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _ready(held.value)
        for batch in batches:
            got = held.value.predict(batch.column(1).to_pylist(), z)
            lang, score, margin = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([x == UNDETERMINED or m < MARGIN for x, m in zip(lang, margin, strict=True)], pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return c.map_arrow(texts, run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _ready(held.value)
        for batch in batches:
            got = held.value.predict(batch.column(at).to_pylist(), z)
            yield batch.filter(pa.array([x != UNDETERMINED and m >= MARGIN for x, _, m in got], pa.bool_()))

    return c.map_arrow(docs, run, docs.schema)
