import math
import random

import numpy as np
from pyspark.sql import functions as F

from boutlog.llm import lm_scoring
from boutlog.llm.packing import encoder
from boutlog.llm.queries import tokenizer_path

RND = random.Random(3)


def letters(n):
    return "".join(RND.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def small_model(seed=1):
    """A model of 300 ids with every parameter at random, ids 280 and above without a training row."""
    rng = np.random.default_rng(seed)
    totals = rng.integers(1, 500, 300)
    totals[280:] = 0
    of_class, inside = lm_scoring.classes(totals, rng.random(300) < 0.5, 299)
    p = {n: (x + rng.normal(0, 0.3, x.shape) * (1 if n != "after" else np.any(x != 0, 1)[:, None])).astype(np.float32) for n, x in lm_scoring.initial(totals, of_class).items()}
    return lm_scoring.AttentionModel(of_class, inside, np.log((totals + 0.05) / (totals + 0.05).sum()), p, 299)


def plain(model, ids):
    """Log probabilities of one text's ids, one at a time, from the parameters: no tables, no batches."""
    p = {n: x.astype(float) for n, x in model.parameters.items()}
    inputs, out = [model.end, *ids[:-1]], []
    for i, target in enumerate(ids):
        first = max(0, i // lm_scoring.STRIDE * lm_scoring.STRIDE - (lm_scoring.WINDOW - lm_scoring.STRIDE))
        e = np.array([p["embed"][x] + p["of_class"][model.of_class[x]] for x in inputs[first : i + 1]])
        w = np.exp((e @ p["k"]) @ (e[-1] @ p["q"]) / math.sqrt(lm_scoring.DIM) + p["distance"][i - first - np.arange(len(e))])
        h = e[-1] + w @ (e @ p["v"]) / w.sum() @ p["o"]
        z = np.exp(h @ p["out"] + p["pair"][model.of_class[inputs[i]]])
        kind = model.of_class[target]
        own = np.flatnonzero(model.of_class == kind)
        inner = np.exp(model.inside[own] + p["after"][own] @ p["before"][inputs[i]])
        out.append(math.log(z[kind] / z.sum()) + math.log(inner[own == target][0] / inner.sum()))
    return out


def test_attention_scores_every_id_as_a_plain_loop_does():
    model, rng = small_model(), np.random.default_rng(4)
    texts = [[*rng.integers(0, 299, n).tolist(), 299] for n in (0, 1, 15, 16, 17, 31, 32, 33, 47, 48, 100, 333, 5, 0, 64, 2, 40, 80, 12, 700)]
    got = model.log_probabilities(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(got, np.concatenate([plain(model, t) for t in texts]), atol=2e-4)


def test_probabilities_of_all_ids_sum_to_one():
    model, rng = small_model(2), np.random.default_rng(5)
    for length in (0, 3, 20, 50):
        before = rng.integers(0, 299, length).tolist()
        texts = [[*before, x, 299] for x in range(300)]
        got = model.log_probabilities(np.concatenate(texts), np.array([len(t) for t in texts])).reshape(300, -1)[:, length]
        assert abs(np.exp(got.astype(float)).sum() - 1) < 1e-5


def test_training_finds_what_depends_on_the_last_id_and_on_one_further_back():
    rng = np.random.default_rng(6)
    follows = rng.permutation(250)
    stream, topic = [299], 0
    while len(stream) < 60_000:  # an id, its follower, then the topic of the line
        topic = int(rng.integers(0, 4)) if rng.random() < 0.05 else topic
        x = int(rng.integers(0, 250))
        stream += [x, int(follows[x]), 250 + topic]
    stream = np.array(stream)
    totals = np.bincount(stream, minlength=300)
    of_class, inside = lm_scoring.classes(totals, np.arange(300) % 2 == 0, 299)
    learner = lm_scoring.Learner(lm_scoring.initial(totals, of_class), of_class, inside)
    learner.pairs(stream)
    windows = stream[(np.arange((len(stream) - 1) // 32) * 32)[:, None] + np.arange(33)]
    for _ in range(3):
        for a in range(0, len(windows), 16):
            learner.step(windows[a : a + 16])
    model = lm_scoring.AttentionModel(of_class, inside, np.log((totals + 0.05) / (totals + 0.05).sum()), learner.p, 299)
    got = model.log_probabilities(stream[1:], np.array([len(stream) - 1]))
    follower, marker = got[1::3], got[2::3]
    assert follower.mean() > math.log(1 / 250) + 1.5  # by frequency alone it would stay at log(1 / 250) or less
    assert marker.mean() > math.log(1 / 4) + 0.3  # the four markers are alike but for what came three ids before
    assert (got - model.single[stream[1:]]).mean() > 0.5


def test_lm_score_of_junk_is_below_prose(spark):
    vocabulary = ["water", "house", "green", "river", "stone", "light", "table", "under", "seven", "never"] * 3 + [letters(5) for _ in range(60)]
    prose = lambda n: " ".join(RND.choice(vocabulary) for _ in range(n))
    texts = {i: prose(30) + " " + " ".join(letters(7) for _ in range(12)) for i in range(60)}  # many words occur once
    texts |= {100: prose(30), 101: " ".join(letters(9) for _ in range(30)), 102: " ".join(vocabulary[:10]) + " " + letters(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = lm_scoring.fit(df.where("doc_id < 100"), tokenizer_path())
    got = {r.doc_id: r for r in lm_scoring.score(df, "doc_id < 100", model, tokenizer_path()).where(F.col("doc_id") >= 100).collect()}
    assert got[101].n_known == 1 and got[100].n_known == 31
    assert got[101].score < got[100].score - 30 and got[101].score < got[101].known_score < 0
    assert abs(got[100].known_score - got[100].score) < 1e-9 and got[102].score < got[102].known_score
    tokenizer = encoder(tokenizer_path()).tokenizer
    for i in (100, 102):  # the whole way from text to score by the plain loop
        ids = [x for w in texts[i].split() for x in tokenizer.encode(" " + w, add_special_tokens=False).ids] + [model.end]
        assert abs(got[i].score - sum(plain(model, ids)) / math.log(10)) < 1e-2
        assert abs(got[i].flat_score - model.single[ids].sum() / math.log(10)) < 1e-6


def test_ids_of_words_are_those_of_each_alone():
    words = [b" " + w.encode() for w in ["the", "<|endoftext|>x", "été", "don't", "a\x1cb", "　wide", "12345", "!!", "ß z", "🙂🙂", letters(40), "x"]]
    tokenizer = encoder(tokenizer_path()).tokenizer
    for some in (words, [w for w in words if b"|" not in w and b"\x1c" not in w and b"\xe3\x80" not in w and b"\xc2\xa0" not in w], [b" one"]):
        ids, lengths = lm_scoring.WordIds(tokenizer_path()).ids_of(some)
        each = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in some]
        assert ids.tolist() == [x for e in each for x in e] and lengths.tolist() == [len(e) for e in each]


def test_every_training_text_is_learnt_from(spark, monkeypatch):
    seen = []
    one_round = lm_scoring._one_round

    def noted(texts_, *args):
        seen.extend(r[0] for r in texts_.collect())
        return one_round(texts_, *args)

    monkeypatch.setattr(lm_scoring, "_one_round", noted)
    given = [f"{letters(4)} {letters(3)} {i}" for i in range(40)]
    lm_scoring.fit(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), tokenizer_path())
    assert sorted(seen) == sorted(given)
