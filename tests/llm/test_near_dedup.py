import random

import pytest

from boutlog.llm import near_dedup

RND = random.Random(31)
VOCAB = ["w%d" % i for i in range(3000)]


def prose(n):
    return [RND.choice(VOCAB) for _ in range(n)]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        words[RND.randrange(len(words))] = "e%d" % RND.randrange(10**6)
    return words


def brute(texts, percent):
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def families():
    """Copies of one text with few to many edits, copies of copies, nested texts, a passage shared by many, drifting tails."""
    out = []
    base = prose(260)
    out += [edited(base, RND.randrange(0, 9)) for _ in range(110)]
    out += [edited(edited(base, 6), RND.randrange(0, 3)) for _ in range(25)]
    long = prose(400)
    out += [long[: 400 - 7 * k] for k in range(30)]
    passage = prose(60)
    out += [passage + prose(RND.randrange(20, 90)) for _ in range(60)]
    shifted = prose(900)
    out += [shifted[9 * k : 9 * k + 300] for k in range(40)]
    return out


@pytest.mark.parametrize("percent, group", [(85, 200), (85, 3), (80, 3)])
def test_families_equal_brute_force(spark, monkeypatch, percent, group):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    shuffled = families()
    RND.shuffle(shuffled)
    texts = {i: " ".join(w) for i, w in enumerate(shuffled)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, percent=percent).collect()}
    assert got == brute(texts, percent)
    assert 20 < len(set(got.values())) < len(got) - 60


def test_rows_without_id_and_ids_with_two_texts(spark):
    a, b = " ".join(prose(80)), " ".join(prose(80))
    data = [(5, a), (5, b), (None, a + " tail"), (None, b), (None, ""), (7, None), (5, a), (9, "one two"), (8, "one two")]
    rows = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows)
    assert got == sorted([(False, 5, 76, 5, True), (False, 5, 76, 5, True), (False, 5, 76, 5, True), (True, 0, 77, 5, False), (True, 0, 76, 5, False), (True, 0, 0, 0, True), (False, 7, 0, 7, True), (False, 8, 1, 8, True), (False, 9, 1, 8, False)])
