"""Operators that return their caller's columns keep them whatever their names."""

import pytest
from pyspark.sql import functions as F

from inkmill.llm import toxicity, urls

ODD = ["a.b", "_x", "_doc", "_fp", "_hash", "best", "page", "labels", "digest", "full", "e", "c0", "words", "node", "rare", "did"]


def with_odd(df):
    return df.select("*", *(F.lit(n).alias(n) for n in ODD if n not in df.columns))


def test_urls_keep_the_callers_columns(spark):
    pages = with_odd(spark.createDataFrame([(1, "http://a.example.com/en/7x", "old"), (2, None, "old")], "page_id long, url string, rule string"))
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, verdict string")
    for some, want in ((rules, ["example.com/en/7", None]), (rules.where("false"), [None, None])):
        got = urls.filter_urls(pages, some)
        assert [c for c in got.columns if c not in ("host", "path", "rule", "verdict")] == [c for c in pages.columns if c != "rule"]
        assert [(r["a.b"], r.best, r["_x"], r.rule) for r in got.orderBy("page_id").collect()] == [("a.b", "best", "_x", w) for w in want]


@pytest.mark.parametrize("bound", [toxicity.BROADCAST_GRAMS, 0])
def test_stages_keep_the_callers_columns(spark, sf, monkeypatch, bound):
    import corpus_pipeline

    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", bound)
    docs = with_odd(spark.read.parquet(f"{sf}/documents.parquet"))
    stages = corpus_pipeline.STAGES[:4] if bound else corpus_pipeline.STAGES[1:2]
    for _, stage in stages:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns
        row = left.first()
        assert [row[n] for n in ODD] == ODD


def test_scores_do_not_depend_on_how_the_table_is_met(spark, sf, monkeypatch):
    """Sent to the tasks or joined, the table of n-grams gives the same scores, also to texts that it doesn't know."""
    labels, docs = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "documents"))
    docs = docs.select("doc_id", "text").where("doc_id < 60").unionByName(spark.createDataFrame([(-1, "ⅷⅷⅷ ⅸⅸⅸ unseen"), (-2, ""), (-3, None)], "doc_id long, text string"))
    sent = toxicity.train(docs, labels)
    joined = {k: v for k, v in sent.items() if k != "sent"}
    one, two = ({r.doc_id: r.score for r in toxicity.score(docs, m).collect()} for m in (sent, joined))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)
