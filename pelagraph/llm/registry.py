"""The thin queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagraph.llm import language_id, lattice_lm, license_scan, mixing, ngram_jaccard, onebit_ann, packing, quality_rules, toxicity, url_filter
from pelagraph.llm.common import crc_mod, keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


ORACLE["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
u AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id
"""


@query
def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def held_out(mod: int, is_: int):
    return F.coalesce(crc_mod("doc_id", mod) == is_, F.lit(False))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.detect(docs, toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted", "best_clause")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = keep(quality_rules.measure(docs), "measured")
    judged = quality_rules.judge(measured, quality_rules.fit(measured, labels))
    return judged.select("doc_id", *(c for c in quality_rules.COUNTS if c != "n_lines"), "base_failed", "kept", "badness")


#: Counts as in the contract; the halves by crc32, which DuckDB lacks, from its table; quantiles by place in sorted lists; binomial tails by sums.
ORACLE["op4_quality_rules"] = rf"""
WITH RECURSIVE bits(n, k, v) AS (SELECT i, 0, i FROM range(0, 256) t(i) UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS tab FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 3) t(j) GROUP BY 1),
c AS MATERIALIZED (SELECT d.doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
m AS MATERIALIZED (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, [n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1)] AS sig FROM c),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING max(quality) = 1),
g AS MATERIALIZED (SELECT m.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(m.doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295::BIGINT) % 2 AS half
  FROM m JOIN good ON good.doc_id = m.doc_id, tab WHERE NOT base_failed),
q AS MATERIALIZED (SELECT lang, i, list_transform(range(1, {quality_rules.LEVELS} + 1), lambda t: xs[greatest(1, ceil(t * len(xs) / {quality_rules.LEVELS}.0 - 1e-9))::BIGINT]) AS qs FROM (SELECT lang, i, list(sig[i] ORDER BY sig[i]) AS xs FROM g, range(1, 4) t(i) WHERE half = 0 GROUP BY 1, 2)),
bad AS MATERIALIZED (SELECT m.doc_id, m.lang, max(len(list_filter(qs, lambda v: v < sig[i]))) AS bad FROM m JOIN q ON m.lang IS NOT DISTINCT FROM q.lang GROUP BY 1, 2),
hold AS (SELECT s.lang, t, count(g.doc_id) AS n, count(g.doc_id) FILTER (bad >= t) AS k FROM (SELECT DISTINCT lang FROM q) s CROSS JOIN range(1, {quality_rules.LEVELS} + 1) r(t) LEFT JOIN g ON g.lang IS NOT DISTINCT FROM s.lang AND g.half = 1 LEFT JOIN bad ON bad.doc_id = g.doc_id GROUP BY 1, 2),
tail AS (SELECT lang, t, CASE WHEN n = 0 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality_rules.ALPHA}) + (n - j) * ln(1 - {quality_rules.ALPHA})))) END AS p FROM hold),
level AS (SELECT lang, coalesce(max(t) FILTER (p > {quality_rules.DELTA} / (SELECT count(DISTINCT coalesce(lang, chr(1))) FROM q)), 0) + 1 AS level FROM tail GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(bad, 0) < coalesce(level, {quality_rules.LEVELS + 1}) AS kept, coalesce(bad, 0)::BIGINT AS badness
FROM m LEFT JOIN bad ON bad.doc_id = m.doc_id LEFT JOIN level ON level.lang IS NOT DISTINCT FROM m.lang
"""


@query
def op5_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The exact neighbours; the search's error bounds have lost none of them on the given tables (its recall in tests: at least 0.97).
ORACLE["op5_onebit_ann"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


# The history of the lists that the query applies.
LIST_ENTRIES = [
    ("gambling", "casino-win.example.com", "add", "2024-02-01"),
    ("gambling", "casino-win.example.com", "remove", "2024-09-15"),
    ("gambling", "casino-win.example.com", "add", "2025-03-01"),
    ("gambling", "free-bets.example.com", "add", "2024-05-10"),
    ("pharma", "cheap-pills.example.com", "add", "2024-01-20"),
    ("pharma", "cheap-pills.example.com", "add", "2024-07-01"),
    ("pharma", "cheap-pills.example.com", "remove", "2025-06-01"),
    ("spam", "tiontion.example.net", "add", "2024-04-01"),
    ("spam", "tiontion.example.net", "remove", "2024-04-01"),
    ("spam", "tiontion.example.net", "add", "2024-11-01"),
    ("spam", "blog.tionsh.example.com/fr", "add", "2024-03-01"),
    ("spam", "blog.tionsh.example.com/fr", "remove", "2025-01-01"),
    ("adult", "ththha.example.net/en", "add", "2024-06-01"),
    ("adult", "m.example.org", "remove", "2024-06-01"),
]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no time: a capture is fetched on day page_id modulo 730 from 2024-01-01 on."""
    return table(spark, sf_dir, "pages").withColumn("fetched_at", F.expr("date_add(DATE '2024-01-01', cast(page_id % 730 as int))"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(LIST_ENTRIES, "list string, pattern string, action string, at string").withColumn("at", F.col("at").cast("date"))
    return url_filter.judge(captures(spark, sf_dir), entries)


ORACLE["op6_url_filter"] = rf"""
WITH e0(list, pattern, action, day) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in LIST_ENTRIES)}),
e1 AS (SELECT list, pattern, day, bool_and(action = 'add') AS is_on FROM e0 GROUP BY list, pattern, day),
e2 AS (SELECT *, lag(is_on) OVER (PARTITION BY list, pattern ORDER BY day) AS before FROM e1),
e3 AS (SELECT * FROM e2 WHERE is_on <> coalesce(before, false)),
e4 AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_until FROM e3),
spans AS (SELECT list, pattern, day AS valid_from, valid_until FROM e4 WHERE is_on),
cap AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS DATE) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.|\.$', '', 'g') AS host,
    rtrim(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/') AS p
  FROM pages),
hits AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(valid_from) AS listed_since
  FROM cap JOIN spans ON fetched_at >= valid_from AND (valid_until IS NULL OR fetched_at < valid_until) AND host <> ''
    AND (host = pattern OR ends_with(host, '.' || pattern) OR contains(pattern, '/') AND starts_with(host || p || '/', pattern || '/'))
  GROUP BY page_id)
SELECT cap.page_id, host, fetched_at, lists, listed_since, lists IS NOT NULL AS blocked FROM cap LEFT JOIN hits ON cap.page_id = hits.page_id
"""


@query
def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc_mod("doc_id", 7)
    return lattice_lm.score(table(spark, sf_dir, "documents"), remainder == 2, remainder != 2)


@query
def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op9_poisson_mixing"] = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
parts AS (SELECT source, greatest(1, ceil(rate / {mixing.MAX_RATE}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {mixing.MAX_RATE})) AS part FROM rates),
terms AS (SELECT source, part, unnest(range(0, ceil(part + 9 * sqrt(part) + 24)::BIGINT + 1)) AS k FROM parts),
cdf AS (SELECT source, k, sum(exp(k * ln(part) - part - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
d AS (SELECT d.*, unnest(range(1, parts + 1)) AS j FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
u AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')), CASE WHEN j > 1 THEN j::VARCHAR END)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u
"""
QUERIES = dict(sorted(QUERIES.items(), key=lambda x: int(x[0][2:].split("_")[0])))
