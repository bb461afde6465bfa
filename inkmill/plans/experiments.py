"""Retrieval experiments with all benchmark items as queries over whole documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, retrieval
from ..staging import staged


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def _embedded(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, embedding.hash_embedding(F.col("text")).alias("embedding"))


def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = _tables(spark, sf_dir)
    return _embedded(documents, "doc_id").select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical(*_tables(spark, sf_dir))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the lexical ranking the vectors alone give, and the fusion of both."""
    documents, queries = _tables(spark, sf_dir)
    lexical = staged(retrieval.lexical(documents, queries), "lexical")
    near = staged(retrieval.vectors(_embedded(documents, "doc_id"), _embedded(queries, "query_id")), "vectors")
    relevant = lexical.select("query_id", "doc_id", (11 - F.col("rank")).alias("gain"))
    each = [retrieval.evaluate(r, relevant).withColumn("ranking", F.lit(n)) for n, r in (("vectors", near), ("fused", retrieval.fuse([lexical, near])))]
    return each[0].unionByName(each[1]).select("ranking", "query_id", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "first")))


_W = r"coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), [])"
_LEXICAL = rf"""
d AS (SELECT doc_id, {_W} AS w FROM documents), z AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
i AS (SELECT doc_id, word, n, count(*) AS tf FROM (SELECT doc_id, len(w)::DOUBLE AS n, unnest(w) AS word FROM d) GROUP BY ALL),
f AS (SELECT word, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS rarity FROM (SELECT word, count(*) AS df FROM i GROUP BY word), z),
q AS (SELECT DISTINCT query_id, unnest(w) AS word FROM (SELECT item_id AS query_id, {_W} AS w FROM benchmark)),
s AS (SELECT query_id, doc_id, sum(CAST(floor(1000000 * rarity * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * i.n / mean)))) AS BIGINT))::BIGINT AS score FROM q JOIN f USING (word) JOIN i USING (word), z GROUP BY ALL),
lex AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM s) WHERE rank <= 10)"""


def _vector_sql(table: str, key: str) -> str:
    codes = f"SELECT {key} AS id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {2 * embedding.DIMENSIONS} AS code FROM (SELECT {key}, unnest({_W}) AS word FROM {table})"
    places = f"SELECT id, code % {embedding.DIMENSIONS} AS place, sum(CASE WHEN code >= {embedding.DIMENSIONS} THEN 1 ELSE -1 END)::BIGINT AS x FROM ({codes}) GROUP BY ALL"
    return f"(SELECT {key} AS id, list(coalesce(x, 0) ORDER BY place) AS v FROM (SELECT {key}, unnest(range({embedding.DIMENSIONS})) AS place FROM {table}) LEFT JOIN (SELECT id AS {key}, place, x FROM ({places})) USING ({key}, place) GROUP BY {key})"


def oracle_sql() -> dict[str, str]:
    norm = lambda v: f"list_sum(list_transform({v}, lambda x: x::DOUBLE * x))"
    return {
        "hash_vectors": f"SELECT id AS doc_id, array_to_string(v, ',') AS vector FROM {_vector_sql('documents', 'doc_id')}",
        "lexical_search": f"WITH {_LEXICAL} SELECT * FROM lex",
        "retrieval_metrics": f"""
WITH {_LEXICAL},
a AS (SELECT id, v::DOUBLE[] AS v, {norm("v")} AS n FROM {_vector_sql("documents", "doc_id")}), b AS (SELECT id, v::DOUBLE[] AS v, {norm("v")} AS n FROM {_vector_sql("benchmark", "item_id")}),
vec AS (SELECT * FROM (SELECT b.id AS query_id, a.id AS doc_id, row_number() OVER (PARTITION BY b.id ORDER BY list_dot_product(a.v, b.v) / sqrt(b.n * a.n) DESC, a.id) AS rank FROM a, b WHERE a.n > 0 AND b.n > 0) WHERE rank <= 10),
fus AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(floor(1000000.0::DOUBLE / (60 + rank))) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT * FROM vec) GROUP BY query_id, doc_id) WHERE rank <= 10),
r AS (SELECT 'vectors' AS ranking, * FROM vec UNION ALL SELECT 'fused', * FROM fus),
e AS (SELECT query_id, doc_id, 11 - rank AS gain, count(*) OVER (PARTITION BY query_id) AS n, sum((11 - rank) / log2(rank + 1)) OVER (PARTITION BY query_id) AS ideal FROM lex)
SELECT k.ranking, e.query_id, round(count(r.rank) / any_value(e.n), 6) AS recall, round(coalesce(sum(gain / log2(r.rank + 1)), 0) / any_value(ideal), 6) AS ndcg, round(coalesce(1 / min(r.rank), 0), 6) AS first
FROM (VALUES ('vectors'), ('fused')) k(ranking) CROSS JOIN e LEFT JOIN r ON r.ranking = k.ranking AND r.query_id = e.query_id AND r.doc_id = e.doc_id GROUP BY ALL
""",
    }
