import math

from pyspark.sql import functions as F

from boutlog.llm import lm_scoring, packing, quality_model, toxicity, urls
from boutlog.llm.queries import tokenizer_path

TEXTS = [(1, "some words of a first text"), (1, "some words of a first text"), (None, "a text without id"), (None, None), (2, ""), (3, None), (4, "y" * 40_000), (5, "other words " * 60), (5, "two texts of one id")]
SCHEMA = "doc_id long, text string"


def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns({"score": F.lit("own"), "held_out": F.lit("own"), "block": F.lit(1), "h": F.lit(2)})


def test_classifiers_take_nulls_repeats_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_model):
        rows = module.scored(docs(spark), labels).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert all((r.held_out is None) == (r.doc_id is None) for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        assert module.scored(docs(spark).limit(0), labels).count() == 0
        assert module.scored(docs(spark), labels.limit(0)).count() == len(TEXTS)


def test_language_model_takes_nulls_repeats_and_empty_tables(spark):
    rows = lm_scoring.scored(docs(spark), tokenizer_path()).collect()
    assert len(rows) == len(TEXTS) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert all((r.held_out is None) == (r.doc_id is None) for r in rows)
    assert len({(round(r.score, 9), round(r.base_score, 9)) for r in rows if r.doc_id == 1}) == 1
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert lm_scoring.scored(docs(spark).limit(0), tokenizer_path()).count() == 0


def test_packing_and_urls_take_null_ids(spark):
    rows = packing.pack(docs(spark), tokenizer_path()).collect()
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 2 and sum(r.start == 0 for r in rows) == len(TEXTS)
    pages = spark.createDataFrame([(None, "http://a.net/es/x"), (1, None), (2, ""), (3, "no scheme"), (4, "http://h.com/" + "z" * 50_000), (4, "http://casino.org/")], "page_id long, url string").withColumn("verdict", F.lit("own"))
    got = sorted(((r.page_id or 0), r.verdict) for r in urls.judge_urls(pages).collect())
    assert got == [(0, "block"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "allow"), (4, "block")]
    assert urls.judge_urls(pages.limit(0)).count() == 0
