"""Operators on single texts: toxicity, language, licences, quality rules, language model, packing, mixing, URLs."""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagraph.llm import language_id, lattice_lm, license_scan, mixing, packing, quality_rules, toxicity, url_filter
from pelagraph.llm.common import WordHash, crc_mod, words_of

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n long"
ODD = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "Hello there, you.", "en", None), (3, "%%% 123 \n\n", "xx", "b"), (4, "word " * 30_000, "en", "b"), (5, "é" * 5_000, None, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, l, s, 1, 0.5, "k", 1) for i, t, l, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---------------------------------------------------------------- toxicity
def test_toxicity_held_out(docs, labels):
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    score = {r.doc_id: (r.score, r.predicted) for r in toxicity.detect(docs, model).collect()}
    seen = [(r.toxic, *score[r.doc_id]) for r in labels.collect() if crc(r.doc_id, 3) == 1]
    pos, neg = [s for y, s, _ in seen if y], [s for y, s, _ in seen if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85
    assert np.mean([p for y, _, p in seen if not y]) < 0.03
    assert all(0 <= s <= 1 for s, _ in score.values())


def test_toxicity_grammar():
    m = toxicity.Model({"idiot": (200, 0)}, 300, 3000, [0.0] * 6)
    r = toxicity.Reader(m)
    best = lambda t: math.expm1(toxicity.features(t, r)[0])
    assert best("you are an idiot") > best("what an idiot") > best("he is not an idiot") > 0
    assert best("she said that idiot") < best("that idiot")
    assert best("we kill you") < best("you we kill") and best("nice day") == 0
    assert best("idiot. not") == best("idiot")  # a clause ends a negation's reach
    steps, factors = toxicity.compose(toxicity.READS)
    assert steps == [[0] * 6] and factors[0][toxicity.INSULT] == 1


def test_composed_machine_is_its_parts():
    """Brute force: each transducer runs on its own, and the factors of all are multiplied word by word."""
    r, parts = random.Random(5), (toxicity.READS, toxicity.NEGATED, toxicity.REPORTED, toxicity.AIMED)
    for _ in range(300):
        classes = [r.randrange(6) for _ in range(r.randrange(12))]
        read = [(k, r.random() if k in (toxicity.INSULT, toxicity.THREAT) else 0.0) for k in classes]
        want, states = 0.0, [m.start for m in parts]
        for k, w in read:
            want += w * math.prod(m.factor(s, k) for m, s in zip(parts, states, strict=True))
            states = [m.step(s, k) for m, s in zip(parts, states, strict=True)]
        assert abs(toxicity.clause_score(read, [str(i) for i in range(len(read))])[0] - want) < 1e-12


def test_toxicity_same_as_brute_force(docs, labels):
    """The arcs' counts and the features of every document, recomputed from plain dictionaries."""
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    truth: dict = {}
    for x in labels.collect():
        if crc(x.doc_id, 3) != 1 and x.toxic is not None:
            truth[x.doc_id] = max(truth.get(x.doc_id, 0), int(x.toxic > 0))
    texts = {x.doc_id: x.text for x in docs.collect()}
    seen: dict = {}
    for i, y in truth.items():
        for arc in {a for w in toxicity._WORD.findall(texts[i].lower()) for a in toxicity.arcs_of(w)}:
            n = seen.setdefault(arc, [0, 0])
            n[1 - y] += 1
    assert (model.toxic, model.clean) == (sum(truth.values()), len(truth) - sum(truth.values()))
    assert model.arcs and all(tuple(seen[a]) == n for a, n in model.arcs.items())
    rate = model.toxic / model.clean
    assert set(model.arcs) == {a for a, (x, y) in seen.items() if x >= toxicity.MIN_TOXIC and x > 1.5 * rate * y}
    reader = toxicity.Reader(model)
    got = {x.doc_id: (x.score, x.predicted) for x in toxicity.detect(docs, model).collect()}
    for i, t in list(texts.items())[:200]:
        s = toxicity.score(toxicity.features(t, reader), model.curve)
        assert abs(got[i][0] - s) < 1e-12 and got[i][1] == (s >= 0.7)


def test_toxicity_conflicting_labels_and_repeated_ids(spark):
    rows = [(i, "you idiot trash" if i % 2 else "a fine day", 9) for i in range(20)] + [(1, "you idiot trash", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _label int")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks, F.lit(True))
    assert (model.toxic, model.clean) == (10, 10) and model.arcs["idiot"] == (10, 0)
    assert toxicity.detect(df, model).count() == 21


def test_toxicity_edges(odd, empty, labels, spark):
    model = toxicity.fit(odd, spark.createDataFrame([(1, 1, 1), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert [r.score for r in toxicity.detect(odd, model).collect()] == [0.0] * len(ODD)
    assert toxicity.detect(empty, toxicity.fit(empty, labels, F.lit(True))).count() == 0


# ---------------------------------------------------------------- language
def test_language_held_out(docs):
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect() if crc(r.doc_id, 4) == 2]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([r.rejected for r in got.values()]) < 0.02
    assert language_id.accepted(docs, model).columns == docs.columns


def test_language_edges(odd, empty, docs):
    model = language_id.fit(docs, F.lit(True))
    got = [r.lang_pred for r in language_id.identify(odd, model).collect()]
    assert [got[i] for i in (0, 1, 2, 4)] == ["und"] * 4 and got[3] in model.dictionaries
    assert language_id.identify(empty, model).count() == 0
    none = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    one = language_id.Model({"en": b"the of and"})
    assert one.predict(["abc"], one.compressors()) == [("en", 1.0, 1.0)]


def test_every_language_is_learned(spark, monkeypatch):
    r, rows = random.Random(6), []
    for i in range(135):
        own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(30)]
        rows += [(4 * i + j, " ".join(r.choice(own) for _ in range(60)), f"l{i:03}") for j in range(1 if i > 130 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    assert len(model.dictionaries) == 135
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()} == {i: lang for i, _, lang in rows}
    texts = [None, "", *(t for _, t, _ in rows[::40])]
    want = model.predict(texts, model.compressors())
    monkeypatch.setattr(language_id, "GROUP", 4)
    assert model.predict(texts) == want and language_id.fit(df, F.lit(True)).dictionaries == model.dictionaries


# ---------------------------------------------------------------- licences
def test_license_templates_and_noise():
    s, r = license_scan.Scanner(), random.Random(1)
    for name, text in license_scan.TEMPLATES.items():
        padded = "lorem ipsum " * 30 + text + " dolor sit " * 20
        m = [x for x in s.find(padded) if x.license == name]
        assert m and m[0].coverage == 1.0 and license_scan.words(padded[m[0].start : m[0].end]) == license_scan.words(text), name
    w = license_scan.words(license_scan.TEMPLATES["BSD-3-Clause"])
    noisy = " ".join("zz" if r.random() < 0.08 else x for x in w)
    assert [x.license for x in s.find(f"a b c {noisy} d e {noisy}")] == ["BSD-3-Clause"] * 2
    assert s.find("the license of the software is under the terms of this") == []


def test_alignment_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a = [r.choice("abcdefghij") for _ in range(r.randrange(30))]
        b = [r.choice("abcdefghij") for _ in range(r.randrange(30))]
        got = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert license_scan.align(list("xaybz"), list("ab")) == [(1, 0), (3, 1)]


def test_license_repeated_notices():
    s = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        for gap in ("\n", "\n* "):
            many = gap.join([text] * 5)
            m = [x for x in s.find(many) if x.license == name]
            assert [many.count(gap[:1], 0, x.start) // (text.count(gap[:1]) + 1) for x in m] == list(range(5)), name
            assert all(x.coverage == 1.0 and license_scan.words(many[x.start : x.end]) == license_scan.words(text) for x in m), name
    noisy = " ".join(["Released under the new MIT License."] * 5)
    assert [x.license for x in s.find(noisy)] == ["MIT-notice"] * 5


def test_gaps_without_unique_words_are_aligned_exactly():
    assert len(license_scan.align(list("cabcab"), list("abcabc"))) == 5
    assert len(license_scan.align("the mit license released under the mit license released under the".split(), "released under the mit license".split())) == 5


def test_license_finds_all_lines(docs, odd, empty):
    want = sum("Apache License, Version 2.0" in r.text for r in docs.select("text").collect())
    got = license_scan.scan(docs).where("license = 'Apache-2.0-notice'").select("doc_id").distinct().count()
    assert got == want > 0
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


# ---------------------------------------------------------------- quality rules
def slow_counts(text):
    text = text or ""
    words = [x for x in text.replace("\x1c", "\0").encode().split()]
    seen, dup, lines = set(), 0, [x for x in text.split("\n") if x.encode().strip()]
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(x) for x in "#*$%&|<>"), dup, len(hit), len(lines))


def test_quality_counts_same_as_brute_force(docs):
    r = random.Random(4)
    texts = [x.text for x in docs.limit(150).collect()] + [None, "", " \n ", "a b a b a b", "x\nx\n x\n\nx", "é ü é ü é ü #"] + ["".join(r.choice("ab \n#é\t") for _ in range(r.randrange(60))) for _ in range(200)]
    got = quality_rules.counts(texts, WordHash())
    assert [tuple(x) for x in got.tolist()] == [slow_counts(t) for t in texts]


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (200, 0, 0.02), (50, 50, 0.3)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality_rules.binomial_tail(k, n, p) - want) < 1e-12
    assert quality_rules.binomial_tail(0, 0, 0.1) == 1.0


def test_certified_levels_keep_the_guarantee():
    r = np.random.default_rng(5)
    bad = 0
    for _ in range(300):
        b = r.integers(0, quality_rules.LEVELS + 1, 400)
        hist = np.bincount(b, minlength=quality_rules.LEVELS + 1)
        level = quality_rules.certified_level(np.cumsum(hist[::-1])[::-1], 400, 0.05, 0.1)
        bad += level <= quality_rules.LEVELS and (quality_rules.LEVELS + 1 - level) / (quality_rules.LEVELS + 1) > 0.05
    assert bad <= 300 * 0.1 * 1.5


def test_quality_end_to_end(docs, labels, odd, empty, spark):
    measured = quality_rules.measure(docs)
    rules = quality_rules.fit(measured, labels)
    got = {r.doc_id: r for r in quality_rules.judge(measured, rules).collect()}
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect()]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.95
    assert set(quality_rules.keep_good(docs, labels).select("doc_id").toPandas()["doc_id"]) == {i for i, r in got.items() if r.kept}
    odd_rows = quality_rules.judge(quality_rules.measure(odd), rules).collect()
    assert [r.base_failed for r in odd_rows] == [True] * len(ODD)
    none = quality_rules.fit(quality_rules.measure(empty), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.level == {} and quality_rules.keep_good(empty, labels).count() == 0


def test_every_language_is_a_stratum(spark):
    """70 languages of clean documents and one, with fewest labels, where each good document is as repetitive."""
    rows = [(1000 * k + i, f"l{k:02}", 100, 500, 0, 0, 0, 5) for k in range(70) for i in range(4)]
    rows += [(900_000 + i, None, 100, 500, 0, 0, 0, 5) for i in range(900)]
    rows += [(990_000 + i, "zz", 100, 500, 40, 4, 40, 5) for i in range(3)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{x} long" for x in quality_rules.COUNTS))
    rules = quality_rules.fit(measured, measured.selectExpr("doc_id", "1 AS quality"))
    assert {x for x in rules.level if x.startswith("l")} == {f"l{k:02}" for k in range(70) if len({crc(1000 * k + i, 2) for i in range(4)} & {0})}
    bad = np.array([rows[-1][2:]], np.int64)
    assert rules.rejects([None], bad).all() and not rules.rejects(["zz"], bad).any() and not rules.rejects(["unseen"], bad).any()


# ---------------------------------------------------------------- language model
def all_segmentations(lattice, s):
    if not s:
        return 1.0
    total = 0.0
    for k in range(1, len(s) + 1):
        head = s[:k]
        if head in lattice.log_p:
            total += math.exp(lattice.log_p[head]) * all_segmentations(lattice, s[k:])
        elif k == 1:
            total += math.exp(sum(lattice.byte[b] for b in head.encode())) * all_segmentations(lattice, s[1:])
    return total


def test_lattice_sums_over_all_segmentations():
    v = lattice_lm.Vocabulary()
    assert abs(sum(map(math.exp, [*v.pieces.values(), *v.bytes.values()])) - 1) < 1e-9
    lattice = lattice_lm.Lattice(v.pieces, v.bytes)
    for w in ("a", "the", "reading", "naïve", "x日本", "zzzq"):
        assert abs(lattice.word(w) - math.log(all_segmentations(lattice, "▁" + w))) < 1e-9
    assert math.isfinite(lattice.word("a" * 20_000))


@pytest.mark.parametrize("head", [400_000, 5])
def test_language_model_same_as_brute_force(spark, docs, head):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(100_001, None), (100_002, ""), (100_003, "zq vex zq"), (100_004, "zq the")]
    v = lattice_lm.Vocabulary()
    lattice, singles = lattice_lm.Lattice(v.pieces, v.bytes), None
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = crc_mod("doc_id", 7)
    got = {r.doc_id: r for r in lattice_lm.score(df, m == 2, m != 2, head=head).collect()}
    train = [words_of((t or "").encode()) for i, t in rows if crc(i, 7) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    words, singles, end = n - len(train), sum(x == 1 for x in c.values()), (len(train) + 1) / (n + 2)
    share = (singles + 1) / (words + 2)

    @functools.cache
    def word(w):
        pieces = all_segmentations(lattice, "▁" + w.decode()) if len(w) < 9 else math.exp(lattice.word(w.decode()))
        return math.log10((1 - end) * (share * pieces + (1 - share) * c[w] / words))

    for i, t in rows:
        w = words_of((t or "").encode())
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, crc(i, 7) == 2)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))
        want = sum(map(word, w)) + math.log10(end)
        assert abs(got[i].score - want) < 1e-6 * max(1, abs(want))


def test_language_model_knows_what_occurs_elsewhere(spark):
    """A document of rare words scores higher if another has them too, wherever the words are counted."""
    r = random.Random(3)
    new = lambda: " ".join("".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(40))
    twice = [new() for _ in range(20)]
    rows = [*enumerate(t for t in twice for _ in (0, 1)), *((100 + i, new()) for i in range(40))]
    for head in (400_000, 3):
        got = {x.doc_id: x.score / x.n_tokens for x in lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), F.lit(True), head=head).collect()}
        assert min(got[i] for i in range(40)) > max(got[i] for i in got if i >= 100)


def test_language_model_edges(odd, empty):
    m = crc_mod("doc_id", 7)
    assert lattice_lm.score(odd, m == 2, m != 2).count() == len(ODD)
    assert lattice_lm.score(empty, m == 2, m != 2).count() == 0


# ---------------------------------------------------------------- packing
def test_ids_are_the_tokenizers(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(6)
    odd = ["", "<|endoftext|>", "a b\u0085c", "x\x1cy\x0b z  ", "日本語 ẞ", "'s 'LL  \n\n\t"] + ["".join(chr(r.choice([r.randrange(1, 0x240), 32, 10])) for _ in range(80)) for _ in range(300)]
    for text in odd + [x.text for x in docs.limit(60).collect()]:
        assert packing.token_ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_keeps_every_id(spark, docs):
    df = docs.union(docs.limit(3))
    got = packing.pack(df, shard_pieces=300).collect()
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for r in docs.limit(80).collect():
        ids = np.append(packing.token_ids(r.text), 1).astype("<u4")
        copies = 2 if len(by_doc[r.doc_id]) > -(-len(ids) // 2048) else 1
        assert sum(p.length for p in by_doc[r.doc_id]) == copies * len(ids)
        for p in by_doc[r.doc_id]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert sum(p.length for p in got) / (2048 * len(by_seq)) > 0.97


def test_packing_edges(spark, odd, empty):
    got = packing.pack(odd).collect()
    assert sum(p.doc_tokens == 1 for p in got) == 3 and {p.doc_id for p in got} == {1, 2, 3, 4, 5, None}
    assert packing.pack(empty).count() == 0


def test_nnls_same_as_exhaustive():
    r = np.random.default_rng(7)
    for _ in range(30):
        a, x = r.integers(0, 3, (5, 4)).astype(float), r.integers(0, 5, 4) * (r.random(4) < 0.6)
        h = a @ x
        assert np.abs(a @ packing.nnls(a, h) - h).max() < 1e-5
    assert sorted(packing.combinations(6, 3, np.ones(7, bool))) == [(1, 1, 4), (1, 2, 3), (1, 5), (2, 2, 2), (2, 4), (3, 3)]


# ---------------------------------------------------------------- mixing
def test_mixing_counts_follow_poisson(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("lang"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    got = mixing.mix(df, weights={"big": 1.0, "small": 1.0, "absent": 5.0}, total=20_000)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert got.columns == df.columns and abs(n["big"] / 10_000 - 1) < 0.05 and abs(n["small"] / 10_000 - 1) < 0.05
    copies = got.where("source = 'small'").groupBy("doc_id").count().groupBy("count").count().collect()
    share = {r[0]: r[1] / 5000 for r in copies}
    assert all(abs(share.get(k, 0) - math.exp(-2) * 2**k / math.factorial(k)) < 0.02 for k in range(1, 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), weights={"big": 1.0, "small": 1.0}, total=20_000).collect()))


def test_mixing_edges(spark, odd, empty):
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd, weights={None: 1.0}).where("source is not null").count() == 0
    assert mixing.mix(empty).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        mixing.mix(odd, total=10_000).count()


def test_mixing_draws_every_rate(spark):
    """Sources of one document beside a large one: rates of about 390, in parts of at most MAX_RATE."""
    big = spark.range(160_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("big").alias("source"))
    small = spark.range(160_000, 160_020).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("source"))
    docs = big.unionByName(small)
    table = {r.source: r.rate for r in mixing.rates(docs).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mix(docs).where("source != 'big'").groupBy("doc_id").count().collect()}
    assert len(got) == 20
    rates = [table[str(i)] for i in sorted(got)]
    assert min(rates) > mixing.MAX_RATE
    for (i, n), rate in zip(sorted(got.items()), rates, strict=True):
        part = rate / math.ceil(rate / mixing.MAX_RATE)
        cdf = np.cumsum([math.exp(k * math.log(part) - part - math.lgamma(k + 1)) for k in range(mixing.poisson_terms(part))])
        keys = [f"{mixing.SEED}|{i}|{hashlib.md5(b't').hexdigest()}" + (f"|{j}" if j > 1 else "") for j in range(1, math.ceil(rate / mixing.MAX_RATE) + 1)]
        assert n == sum(int((cdf <= int(hashlib.md5(k.encode()).hexdigest()[:13], 16) / 2**52).sum()) for k in keys)
    z = (np.array([n for _, n in sorted(got.items())]) - rates) / np.sqrt(rates)
    assert abs(z.mean()) < 1 and 0.4 < z.std() < 1.7


# ---------------------------------------------------------------- URLs
def test_url_filter_as_of(spark):
    d = datetime.date
    e = spark.createDataFrame([("l", "bad.org", "add", d(2024, 2, 1)), ("l", "bad.org", "add", d(2024, 2, 5)), ("l", "bad.org", "remove", d(2024, 3, 1)), ("m", "www.site.com/x/", "add", d(2024, 1, 1)), ("l", "never.org", "remove", d(2024, 1, 1)), ("l", "same.org", "add", d(2024, 1, 1)), ("l", "same.org", "remove", d(2024, 1, 1)), (None, "a.b", "add", d(2024, 1, 1)), ("l", None, "add", d(2024, 1, 1))], "list string, pattern string, action string, at date")
    c = [(1, "http://bad.org/", d(2024, 1, 31)), (2, "http://a.BAD.org:80/q?x", d(2024, 2, 1)), (3, "http://bad.org", d(2024, 2, 29)), (4, "http://bad.org", d(2024, 3, 1)), (5, "https://u:p@www.site.com//x/y#f", d(2024, 5, 1)), (6, "https://site.com/xy", d(2024, 5, 1)), (7, None, d(2024, 5, 1)), (8, "nonsense", d(2024, 5, 1)), (9, "http://bad.org/", None), (10, "http://notbad.org/", d(2024, 2, 9)), (2, "http://a.BAD.org:80/q?x", d(2024, 2, 1)), (11, "http://same.org/", d(2024, 2, 1))]
    captures = spark.createDataFrame([(*x, "h", "p") for x in c], "page_id long, url string, fetched_at date, host string, lists string")
    for limit in (100_000, 0):
        url_filter.BROADCAST_ROWS, before = limit, url_filter.BROADCAST_ROWS
        got = url_filter.judge(captures, e).collect()
        url_filter.BROADCAST_ROWS = before
        assert sorted(r.page_id for r in got if r.blocked) == [2, 2, 3, 5] and len(got) == len(c)
        assert {r.lists for r in got if r.blocked} == {"l", "m"}
    assert url_filter.judge(captures.limit(0), e).count() == 0
    assert not any(r.blocked for r in url_filter.judge(captures, e.limit(0)).collect())


# ---------------------------------------------------------------- brute force
def test_scanner_against_exact_alignment():
    """Noisy templates amid other words: found if the exact longest common subsequence of the place covers enough, not found if that of
    the whole text does not."""
    s, r = license_scan.Scanner(), random.Random(11)
    seen = Counter()
    for name, t in s.templates.items():
        for _ in range(25):
            w, rate = [], r.choice([0.02, 0.1, 0.2, 0.3])
            for x in t:
                kind = r.random()
                w += [x] if kind > rate else ["zz"] if kind > rate / 2 else [] if kind > rate / 4 else [x, "qq"]
            text = " ".join(["lorem"] * 30 + w + ["ipsum"] * 30)
            found = [m for m in s.find(text) if m.license == name]
            whole = len(license_scan.common(license_scan.words(text), t))
            if whole < s.least(name):
                assert not found
                seen["no"] += 1
            else:
                others = [m for m in s.find(text) if m.license != name]  # a longer template may hold a shorter one
                assert found or others, (name, text)
                assert all(s.least(name) <= m.matched <= whole for m in found)
                seen["yes"] += 1
    assert min(seen["yes"], seen["no"]) > 20


def test_nnls_against_every_active_set():
    r = np.random.default_rng(12)
    for _ in range(40):
        a, h = r.integers(0, 3, (6, 4)).astype(float), r.integers(0, 9, 6).astype(float)
        best = float((h**2).sum())
        for mask in range(1, 16):
            at = [i for i in range(4) if mask >> i & 1]
            x = np.linalg.lstsq(a[:, at], h, rcond=None)[0]
            if x.min() >= -1e-9:
                best = min(best, float(((a[:, at] @ x - h) ** 2).sum()))
        x = packing.nnls(a, h)
        assert x.min() >= 0 and float(((a @ x - h) ** 2).sum()) <= best + 1e-5


def test_plans_are_partitions_near_the_optimum():
    """Against the best of all partitions, by dynamic programming over subsets."""
    r = np.random.default_rng(13)
    for _ in range(25):
        n = int(r.integers(1, 10))
        lengths = r.integers(1, 65, n)
        plan = packing.plan(lengths, 64, 4, 3)
        assert sorted(i for p in plan for i in p) == list(range(n)) and all(lengths[p].sum() <= 64 for p in plan)
        need = [(0, 0)] + [(99, 0)] * ((1 << n) - 1)  # (sequences, room used in the last)
        for m in range(1, 1 << n):
            for i in range(n):
                if m >> i & 1:
                    count, used = need[m ^ (1 << i)]
                    need[m] = min(need[m], (count, used + lengths[i]) if count and used + lengths[i] <= 64 else (count + 1, int(lengths[i])))
        assert len(plan) <= need[-1][0] + 1


def test_very_long_urls(spark):
    d = datetime.date(2024, 1, 1)
    url = "http://site.org/" + "/".join(f"p{i}" for i in range(20_000))
    got = url_filter.judge(spark.createDataFrame([(1, url, d), (2, url + "/x", d)], "page_id long, url string, fetched_at date"), spark.createDataFrame([("l", "site.org/p0/p1", "add", d), ("m", "site.org/p1", "add", d)], "list string, pattern string, action string, at date"))
    assert {r.lists for r in got.collect()} == {"l"}
