import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from boutlog.llm import resampling

RND = random.Random(3)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def features(text):
    w = WORD.findall(low(text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10_000) / ((a + 1) * (T + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[0]: k for k, r in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return sorted([(*r[:4], rank.get(r[0]) if r[4] >= 20 else None) for r in rows], key=str)


def prose(n, words=400):
    return RND.choice(" \n-_.").join(RND.choice("wWéß") + str(RND.randrange(words)) for _ in range(n))


def test_equals_brute_force(spark):
    texts = [None, "", "  \t!?", "one", "One two", "über-straße ÄÖ x9", "a b c d", "x" * 50_000, prose(70_000, 30), "same words again " * 9]
    docs = list(enumerate(texts)) + [(100 + i, prose(RND.randrange(15, 60))) for i in range(300)] + [(500 + i, "copy of one text " * 6) for i in range(150)]
    target = [prose(40, 60), None, "", "one two three"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(9), "id": F.lit("own"), "n_words": F.lit(0), "_place": F.lit(1)}).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resampled(df, bench).collect()), key=str)
    assert got == brute(docs, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100 > 10


def test_ring_over_parts(monkeypatch):
    words = [b"w%d" % RND.randrange(50) for _ in range(37)]
    want = sorted(zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    for part in (1, 2, 3, 5, 36, 37, 100):
        monkeypatch.setattr(resampling, "PART", part)
        assert sorted(x for p in resampling.crc_ring(words, 4) for x in p) == want


def test_ties_nulls_and_empty_tables(spark):
    text = "some words of a text " * 5
    docs = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = resampling.resampled(docs, bench, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and [r["rank"] for r in got if r.doc_id == 3] == [None]
    assert resampling.resampled(docs.limit(0), bench).count() == 0
    assert resampling.resampled(docs, bench.limit(0)).count() == 5
