"""Texts of more than one block (2 MiB), of words and of one word, through every operator that reads documents."""

import math
import random
import zlib

import numpy as np
import pytest

from boutlog.llm import decontam, line_dedup, lm_scoring, near_dedup, packing, quality_model, quality_rules, resampling, sharding, simhash_dedup, toxicity
from boutlog.llm.queries import tokenizer_path
from boutlog.session import stored

RND = random.Random(31)
WORDS = ["wort%d" % i for i in range(900)]
LINES = [" ".join(RND.choice(WORDS) for _ in range(12)) for _ in range(32_000)]
LONG = "\n".join(LINES)
ITEM = "a passage of the benchmark that stands at the very end of a text of several blocks"
TEXTS = {1: LONG, 2: LONG, 3: "y" * 2_300_000, 4: LONG + " " + ITEM.replace("several", "severel"), 5: "a short text of few words"}
COUNT = 12 * len(LINES)


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 2_500_000
    return stored(spark.createDataFrame([(i, t, "en", "web") for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string").repartition(2))


def test_ids_and_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path()).toPandas()
    for i in (1, 3):
        ids, at = np.array([*t.encode(TEXTS[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    measured = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.measure(docs).select("doc_id", "n_words", "word_chars").collect()}
    assert measured[1] == (COUNT, len(LONG) - COUNT + 1) and measured[3] == (1, 2_300_000)
    sizes = {r.doc_id: r.size for r in sharding.shard_rows(docs).collect()}
    assert sizes == {i: len(t.encode()) + 8 for i, t in TEXTS.items()}


def test_duplicates_and_passages(spark, docs):
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    sim = {r.doc_id: (r.component_id, r.fingerprint) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert sim[2] == sim[1] and sim[4][0] == 1 and sim[3][0] == 3
    gone = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert gone[1] == (0, LONG) and gone[2] == (len(LINES), "") and gone[3][0] == 0 and gone[4][0] == len(LINES) - 1
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = [(r.doc_id, r.edits, TEXTS[r.doc_id][r.begin : r.end]) for r in decontam.contaminated(docs, bench).collect()]
    assert found == [(4, 1, ITEM.replace("several", "severel"))]


def test_scores(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_model):
        got = {r.doc_id: r.score for r in module.scored(docs, labels).collect()}
        assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    scored = {r.doc_id: r for r in lm_scoring.scored(docs, tokenizer_path()).collect()}
    assert scored[1].n_tokens == COUNT + 1 and scored[3].n_tokens == 2 and all(math.isfinite(r.score) for r in scored.values())
    weights = {r.doc_id: r for r in resampling.resampled(docs, spark.createDataFrame([(LONG[:5000],)], "text string")).collect()}
    assert weights[1].n_features == 3 * COUNT - 3 and weights[3].n_features == 1 and weights[1].weight == weights[2].weight
