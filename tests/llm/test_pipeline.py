"""The pipeline's stages, each against a plain version of what it decides."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from test_pairs import brute
from test_texts import crc, slow_counts

import corpus_pipeline
from pelagraph.llm import language_id, mixing, packing, quality_rules, registry
from pelagraph.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> (rows that came in, rows that left), as written tables."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        got.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_but_the_last_return_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")
    assert all(after.count() for _, after in stages.values())


def test_run_applies_the_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["packing"][1])


def predicted(model, text):
    """(language, margin): a fresh compressor for every block and dictionary."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not any(map(str.isalpha, words)):
        return None, 0.0
    data, total = f" {words} ".encode(), {}
    for lang, raw in model.dictionaries.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        total[lang] = sum(len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_dict_id=False).compress(data[i : i + 4096] + b"\0" * 64)) for i in range(0, len(data), 4096))
    best = min(total, key=lambda x: (total[x], x))
    second = min(v for k, v in total.items() if k != best)
    return best, (second - total[best]) / second


def test_language_stage(stages):
    docs, after = stages["language_id"]
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    want = [tuple(r) for r in docs.collect() if predicted(model, r.text)[0] is not None and predicted(model, r.text)[1] >= 0.002]
    assert rows(after) == sorted(want, key=repr)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in docs.collect():
        lang, margin = predicted(model, r.text)
        assert got[r.doc_id].lang_pred == (lang or "und") and abs(got[r.doc_id].margin - margin) < 1e-12


def plain_rules(docs, labels):
    """lang -> level and quantiles, by sorting and by sums of binomial terms."""
    good = defaultdict(int)
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            good[r.doc_id] = max(good[r.doc_id], r.quality)
    halves = defaultdict(lambda: ([], []))
    for r in docs:
        n = slow_counts(r.text)
        if good.get(r.doc_id) == 1 and n[0] >= 50 and 100 * n[4] <= 50 * n[0]:
            halves[r.lang][crc(r.doc_id, 2)].append(plain_signals(n))
    out = {}
    strata = [x for x, (fit, _) in halves.items() if fit]
    for lang in strata:
        fit, hold = halves[lang]
        q = [[sorted(s[i] for s in fit)[max(0, math.ceil(t * len(fit) / 200 - 1e-9) - 1)] for t in range(1, 201)] for i in range(3)]
        bad = [max(sum(v < s[i] for v in q[i]) for i in range(3)) for s in hold]
        level = 201
        for t in range(200, 0, -1):
            k, n = sum(b >= t for b in bad), len(bad)
            if sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > 0.05 / len(strata):
                break
            level = t
        out[lang] = level, q
    return out


def plain_signals(n):
    return n[2] / max(n[1], 1), n[3] / max(n[5], 1), n[4] / max(n[0], 1)


def plain_kept(text, lang, rules):
    n = slow_counts(text)
    if n[0] < 50 or 100 * n[4] > 50 * n[0]:
        return False
    level, q = rules.get(lang, (201, [[], [], []]))
    return max(sum(v < s for v in q[i]) for i, s in enumerate(plain_signals(n))) < level


def test_quality_stage_and_query(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    docs, after = stages["quality_rules"]
    rules = plain_rules(docs.collect(), labels)
    assert rows(after) == sorted((tuple(r) for r in docs.collect() if plain_kept(r.text, r.lang, rules)), key=repr)
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rules = plain_rules(every, spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect())
    got = {r.doc_id: r.kept for r in registry.QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: plain_kept(r.text, r.lang, rules) for r in every}


def test_rejection_takes_effect(spark):
    """Enough labels to certify a level: what exceeds it goes, by both ways to apply the rules."""
    clean = [(i, " ".join(f"w{(i * 7 + j) % 997}x{j}" for j in range(80)), "en", 1) for i in range(1200)]
    junk = [(5000 + i, " ".join(f"#$w{j}%" for j in range(80)), "en", 1) for i in range(20)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, _stratum int")
    labels = spark.createDataFrame([(i, 1) for i in range(1200)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == set(range(1200))
    measured = quality_rules.measure(docs)
    assert {r.doc_id for r in quality_rules.judge(measured, quality_rules.fit(measured, labels)).where("kept").collect()} == kept


def test_near_duplicate_stage(stages):
    docs, after = stages["ngram_jaccard_join"]
    classes = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(after) == sorted((tuple(r) for r in docs.collect() if classes[r.doc_id][1] == r.doc_id), key=repr)
    assert after.count() < docs.count()


def test_mixing_stage(stages):
    docs, after = stages["mixing"]
    n = Counter(r.source for r in docs.collect())
    total, roots = sum(n.values()), sum(math.sqrt(x) for x in n.values())
    want = []
    for r in docs.collect():
        rate = math.sqrt(n[r.source]) / roots * total / n[r.source]
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        copies, c = 0, 0.0
        while (c := c + math.exp(-rate) * rate**copies / math.factorial(copies)) <= u:
            copies += 1
        want += [tuple(r)] * copies
    assert rows(after) == sorted(want, key=repr)


def test_packing_stage(stages):
    docs, after = stages["packing"]
    ids = {r.doc_id: np.append(packing.token_ids(r.text), 1).astype("<u4") for r in docs.collect()}
    copies, pieces, sequences = Counter(r.doc_id for r in docs.collect()), Counter(), defaultdict(list)
    for p in after.collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        pieces[p.doc_id, p.start, p.length] += 1
        sequences[p.sequence_id].append((p.offset, p.length))
    want = Counter()
    for i, n in copies.items():
        for at in range(0, len(ids[i]), 2048):
            want[i, at, min(2048, len(ids[i]) - at)] += n
    assert pieces == want
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 2048


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null and empty texts, languages and sources, a very long text, clashing column names."""
    base = "the quick brown fox jumps over the lazy dog while many other small animals look on and wonder what it means to jump so high at this hour of the day "
    odd = [(1, base * 3, "en", "a"), (1, base * 3, "en", "a"), (1, "other words entirely " * 40, None, None), (None, base * 2, "en", "a"), (None, None, None, None), (3, "", "en", "b"), (4, None, "de", "b"), (5, " ".join(f"word{i % 9000}" for i in range(60_000)), "en", "b"), (6, "%%% ### 123", None, "c")]
    docs = spark.createDataFrame([(i, t, x, s, 1, 2, 3, 4, 5.0) for i, t, x, s in odd], "doc_id long, text string, lang string, source string, n_chars long, key long, _stratum int, _copy int, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == "packing"
        assert out.count() <= 3 * docs.count() + 40 or name == "packing" and out.select("doc_id").distinct().count() == 6, name
    kept = STAGES["ngram_jaccard_join"](spark, docs, SF).collect()
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in kept), key=repr) == sorted([(1, "the q"), (1, "other"), (None, "the q"), (None, ""), (3, ""), (4, ""), (5, "word0"), (6, "%%% #")], key=repr)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_holdout_column(spark):
    got = registry.QUERIES["op2_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_equal_totals_go_to_the_first_language():
    model = language_id.Model({"b": b"same content here", "a": b"same content here"})
    assert model.predict(["some text"]) == [("a", 0.0, 0.0)]


def test_mixing_names_do_not_clash(spark):
    df = spark.createDataFrame([(i, "t", "s", 1, 2, 3) for i in range(50)], "doc_id long, text string, source string, _copy int, _SOURCE int, _cdf int")
    got = mixing.mix(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3)}
