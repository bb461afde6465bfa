"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, ann, licences, pieces, quality, ranked, resample, tokens, toxicity, warc
from .common import scratch, table
from .decontaminate import overlaps
from .neardup import near_duplicates
from .urls import filter_urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_ids(table(spark, sf_dir, "documents"), path, os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_ids(spark, path)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return _predicted(toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels"))), 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return _predicted(quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels"))), 0.3)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(warc.derive(warc.responses(table(spark, sf_dir, "pages"))), path)
    return warc.read_warc(spark, path)


def piece_model() -> dict:
    """The public piece model; elsewhere pass another path to pieces.read_model."""
    return pieces.read_model(os.environ.get("PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    return pieces.decode(pieces.encode_ids(table(spark, sf_dir, "documents"), model), model).select("doc_id", "ids", "decoded")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "postings")
    ranked.build_index(table(spark, sf_dir, "documents"), path)
    found = ranked.search(ranked.read_index(spark, path), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_nearest, op2_decontamination, op3_repair_tokens, op4_licences, op5_toxicity, op6_quality, op7_url_filter, op8_warc, op9_pieces, op10_near_duplicates, op11_simhash, op12_ranked, op13_resampling)
    return {f.__name__: f for f in every}


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all(" + _LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLES = {
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS w FROM documents),
it AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw),
hit AS (SELECT rid, occ.n, i, item_id FROM occ JOIN win USING (n, s)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)
""",
    "op7_url_filter": """
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h) + length(p) DESC, length(h) DESC, v DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
""",
}


ORACLES["op10_near_duplicates"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWERED.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT rid, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + n - 1], ' ') AS s FROM g),
c AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
j AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT j.a, j.b FROM j JOIN c x ON x.rid = j.a JOIN c y ON y.rid = j.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, component_id, coalesce(d.doc_id = component_id, d.doc_id IS NULL AND component_id IS NULL) AS kept
FROM d LEFT JOIN c USING (rid) JOIN m USING (rid)
"""


_TERMS = r"coalesce(regexp_extract_all(" + _LOWERED.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

ORACLES["op12_ranked"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
s AS (SELECT qid, item_id, rid, CAST(sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (rid), c GROUP BY qid, item_id, rid),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

# The checksum's table follows from its polynomial; a feature's bytes are read from its hexadecimal form.
ORACLES["op13_resampling"] = f"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
x AS (SELECT row_number() OVER () AS rid, doc_id, true AS own, {_WORDS.format("text")} AS w FROM documents UNION ALL SELECT -row_number() OVER (), NULL, false, {_WORDS.format("text")} FROM benchmark),
g AS (SELECT rid, own, unnest(w) AS f FROM x UNION ALL SELECT rid, own, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM x),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
b AS (SELECT f, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT)), lambda c, y: xor(crc[xor(c & 255, y) + 1], c >> 8))) % 10000 AS b FROM u, k),
n AS (SELECT b, CAST(sum(own::INT) AS DOUBLE) AS s, CAST(sum((NOT own)::INT) AS DOUBLE) AS t FROM g JOIN b USING (f) GROUP BY b),
v AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
m AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM g JOIN b USING (f) JOIN v USING (b) WHERE own GROUP BY rid),
e AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM x LEFT JOIN m USING (rid) WHERE own),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM e),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features, rid) AS rank FROM z WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN rank <= (25 * (SELECT count(*) FROM r)) // 100 THEN rank END AS BIGINT) AS rank
FROM z LEFT JOIN r USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
