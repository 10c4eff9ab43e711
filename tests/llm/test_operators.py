import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlog.llm import decontam, line_dedup, lm_scoring, near_dedup, packing, quality_model, quality_rules, sharding, toxicity, urls
from boutlog.llm.queries import tokenizer_path
from boutlog.session import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RND = random.Random(11)
VOCAB = ["w%d" % i for i in range(400)]


def prose(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


BASE = prose(120)
LINES = ["\n".join(prose(12) for _ in range(6)) for _ in range(3)]
TEXTS = [
    None, "", "   \n\t", "one two", "one two", "Fünf wörter sind hier drin", BASE, BASE, BASE.upper(), BASE + " tail", BASE.replace("w1 ", "zz ", 1), prose(60), prose(60) + "\n" + LINES[0],
    LINES[0] + "\n" + prose(30), prose(20) + "\n" + LINES[0] + "\nend", "\n".join(["same line here"] * 40), " ".join(["a b c"] * 60), "x" * 50_000, prose(6000), "!!! $$$ ### | | |", "win win casino " + prose(80),
]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en" if i % 2 else None, None if i % 3 else "web", len(t or "")) for i, t in enumerate(TEXTS)]
    data.append((None, "a row without id and with a few words", None, None, 1))
    return spark.createDataFrame(data, SCHEMA).withColumns({"score": F.lit("clash"), "kept": F.lit(1), "shard": F.lit("x"), "n": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_urls(spark):
    cases = {"http://a.COM/x": ("a.com", "/x", "com/", "allow"), "https://www.example.com/en/p?q": ("www.example.com", "/en/p", "www.example.com/en/", "allow"), "https://b.example.com/en/": ("b.example.com", "/en/", "example.com/en/", "block"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://x.org/casino": ("x.org", "/casino", None, "block"), "http://x.org/casinos": ("x.org", "/casinos", None, "allow"), "http://x.org/free-win": ("x.org", "/free-win", None, "block"), "http://x.org/free-free": ("x.org", "/free-free", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow")}
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got == {i: v for i, v in enumerate(cases.values())}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    spelled = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y " * 40, "<|endoftext |> <|end"]
    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text").union(docs.sparkSession.createDataFrame([(100 + i, x) for i, x in enumerate(spelled)], "doc_id long, text string"))
    got = packing.pack(some.withColumns({"start": F.lit("own"), "length": F.lit(0), "offset": F.lit(None)}), tokenizer_path()).toPandas()
    assert 50256 in t.encode(spelled[0]).ids
    for i, text in [*enumerate(TEXTS), *((100 + i, x) for i, x in enumerate(spelled))]:
        ids, at = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_differencing_is_near_even():
    parts = packing.difference(np.array([RND.randrange(20, 500) for _ in range(600)]), 80)
    assert len(set(parts)) == 80
    sizes = np.array([500] * 10)
    parts, k = packing.divide(sizes, 900)
    assert k == 10 and np.bincount(parts, weights=sizes).max() <= 900


def test_quality_rules(docs, empty):
    measured = cut(quality_rules.measure(docs))
    got = {r.doc_id: r for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()}
    for i, text in enumerate(TEXTS):
        words = WORD.findall(text or "")
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        twice = Counter(windows)
        repeat = len({j + d for j, w in enumerate(windows) if twice[w] > 1 for d in range(3)})
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words)) and not (r.base_failed and r.kept)
    assert got[6].kept and got[11].kept
    m = cut(quality_rules.measure(empty))
    assert quality_rules.judge(m, quality_rules.thresholds(m)).count() == 0


@pytest.mark.parametrize("n", [0, 300])
def test_toxicity(spark, docs, n):
    bad = ["stupid", "idiot", "moron", "trash"]
    data = [(1000 + i, prose(30) + (" " + RND.choice(bad) + " " + RND.choice(bad) if i % 3 == 0 else ""), i % 3 == 0) for i in range(n)]
    labelled = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.fit_labelled(labelled, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text", F.lit(1).alias("score")), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(TEXTS) + 1
    if n:
        a, b, c = model.score([b"you stupid idiot", b"you stuppid idiott", prose(20).encode()])
        assert a > 0.5 and b > c
    else:
        assert set(got.values()) == {0.5}


def brute_components(texts):
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()}
    assert got == brute_components(dict(enumerate(TEXTS)))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_drifting_copies(spark):
    texts, words = {}, prose(200).split()
    for i in range(150):  # copies that drift away from one another: many pairs close to the threshold
        if i % 10 == 0:
            now = list(words)
        for _ in range(RND.randrange(3)):
            now[RND.randrange(200)] = "n%d" % RND.randrange(10_000)
        texts[i] = " ".join(now)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == brute_components(texts)


def test_sharding(docs, empty):
    got = sharding.shard_rows(docs).toPandas()
    assert len(got) == len(TEXTS) + 1
    for r in got.dropna(subset=["doc_id"]).itertuples():
        b = (TEXTS[int(r.doc_id)] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == zlib.crc32(b) and r.grown_shard in (r.shard, 24)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard_rows(empty).count() == 0


def test_sharding_is_even_and_local(spark):
    got = spark.range(20_000).select(sharding.place(F.col("id").cast("string"), 24).alias("a"), sharding.place(F.col("id").cast("string"), 25).alias("b"), sharding.place(F.col("id").cast("string"), 24, {3: 2.0}).alias("c")).toPandas()
    n = got.a.value_counts()
    assert len(n) == 24 and n.min() > 600 and n.max() < 1050
    assert (got.b[got.a != got.b] == 24).all() and 0.02 < (got.b == 24).mean() < 0.06
    assert (got.c[got.a != got.c] < 8).all()


def test_quality_model(spark, docs):
    good = [(i, ". ".join(prose(9).capitalize() for _ in range(12)) + ".", 1) for i in range(200)]
    web = [(1000 + i, ("BUY NOW!!! " + prose(3) + " $$$ ||| ") * 12 if i % 2 else ". ".join(prose(9).capitalize() for _ in range(12)) + ".", 0) for i in range(300)]
    rows = cut(quality_model.measured(spark.createDataFrame([x[:2] for x in good + web], "doc_id long, text string").repartition(3), "doc_id", "text"))
    model = quality_model.fit_positives(rows, spark.createDataFrame([(i, 1) for i, _, _ in good], "doc_id long, quality int"))
    s = model.score(quality_model.measures([x[1].encode() for x in web]))
    assert s[::2].mean() > s[1::2].mean() + 0.3
    assert 0.35 < model.prior < 0.65  # half of the unlabelled rows are good
    got = quality_model.score(quality_model.measured(docs, "doc_id", "text"), model).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("prior", [None, 0.3, 0.9])
def test_gradients_of_the_risk(prior):
    rng = np.random.default_rng(4)
    p, u = rng.standard_normal((7, 5)), rng.standard_normal((11, 5))
    for seed in range(6):
        layers = quality_model.start(5, seed)
        value, negative, gradients = quality_model.risk(layers, p, u, prior, decay=0.0)
        # where the negatives' part is below zero a step follows the gradient of its negative alone
        aim = (lambda ls: quality_model.risk(ls, p, u, prior, 0.0)[0]) if negative >= 0 else (lambda ls: -quality_model.risk(ls, p, u, prior, 0.0)[1])
        for k, g in enumerate(gradients):
            for at in np.ndindex(g.shape):
                moved = [[w.copy() for w in layers] for _ in range(2)]
                moved[0][k][at] += 1e-6
                moved[1][k][at] -= 1e-6
                assert abs((aim(moved[0]) - aim(moved[1])) / 2e-6 - g[at]) < 1e-5


def test_prior_of_tails():
    rng = np.random.default_rng(5)
    positives, unlabelled = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 4000), rng.normal(-2, 1, 6000)])
    cuts = quality_model.tail_cuts(positives)
    above = np.array([(unlabelled >= c).sum() for c in cuts])
    brute = min(((unlabelled >= c).mean() + np.sqrt(np.log(20) / 6000) + np.sqrt(np.log(20) / 20000)) / (positives >= c).mean() for c in cuts)
    found = quality_model.estimate_prior(positives, cuts, above, len(unlabelled))
    assert abs(found - 0.4) < 0.03 and found < brute


def test_lm_base_score(spark, docs, empty):
    some = docs.where("doc_id IS NOT NULL")
    got = {r.doc_id: r for r in lm_scoring.scored(some, tokenizer_path()).collect()}
    tokens = {i: [*WORD.findall(low(t or "")), None] for i, t in enumerate(TEXTS)}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(got[i].base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 and got[i].score <= 0
    assert lm_scoring.scored(empty, tokenizer_path()).count() == 0


def test_decontamination(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew strange potions"
    edited = item.replace("brown", "browm").replace("seven", "sevn")
    texts = [(1, "head " + item.upper() + " tail"), (2, edited), (3, prose(100)), (4, item[:40]), (5, None), (6, ""), (7, item + item), (8, prose(3000) + edited), (9, "razy dog while seven wizards brew strange potions"), (10, "x " + item[:60])]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame([(70, item), (71, None), (72, "")], "item_id long, text string")
    got = {r.doc_id: r.edits for r in decontam.contaminated(d, b).collect()}
    assert got == {1: 0, 2: 2, 7: 0, 8: 2}
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.contaminated(empty, b).count() == 0


def test_line_dedup(docs, empty):
    some = docs.where("doc_id IS NOT NULL")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(some).collect()}
    assert got[0].text is None and got[1].text == "" and got[12].text == TEXTS[12]
    assert LINES[0] not in got[13].text and LINES[0] not in got[14].text and got[14].text.endswith("end") and got[13].removed_lines == 6
    assert got[7].text == "" and got[6].text == TEXTS[6] and got[11].text == TEXTS[11]
    first = defaultdict(int)
    for i in sorted(got):
        for line in (got[i].text or "").split("\n"):
            if len(WORD.findall(line)) >= 50:
                first[low(line.strip())] += 1
    assert max(first.values()) == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_line_dedup(texts):
    """Places to delete: lines of a run of 50 words or more that stands earlier, in the order of ids and lines; all positions compared."""
    lines = {i: [(p, low(x.strip()), len(WORD.findall(x))) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in texts.items()}
    gone = {i: set() for i in texts}
    for i, mine in lines.items():
        for j, other in lines.items():
            for shift in range(1 - len(other), len(mine)):
                if j > i or (j == i and shift <= 0):
                    continue
                run = []
                for k in range(len(mine) + 1):
                    if k < len(mine) and 0 <= k - shift < len(other) and mine[k][1] == other[k - shift][1]:
                        run.append(mine[k])
                        continue
                    if sum(w for _, _, w in run) >= 50:
                        gone[i] |= {p for p, _, _ in run}
                    run = []
    return {i: sorted(x) for i, x in gone.items()}


def test_line_dedup_where_the_first_holder_of_a_line_lacks_the_run(spark):
    run = [prose(12) for _ in range(6)]
    texts = {i: prose(30) + "\n" + line for i, line in enumerate(run)}  # each line of the run first stands alone
    texts[10], texts[11] = "\n".join([prose(9), *run, prose(9)]), "\n".join([prose(9), *run])
    pool = [prose(RND.choice([1, 3, 9, 20, 55])) for _ in range(40)]
    for i in range(20, 80):  # pieces of one sequence of uneven lines, so that runs end anywhere
        parts = [pool[a : a + RND.randrange(1, 14)] + [prose(4)] * RND.randrange(2) for a in (RND.randrange(40), RND.randrange(40))]
        texts[i] = "\n".join(parts[0] + parts[1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_line_dedup(texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert want[11] == [1, 2, 3, 4, 5, 6] and not want[10]
    for i, t in texts.items():
        assert got[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i]) and got[i].removed_lines == len(want[i])
