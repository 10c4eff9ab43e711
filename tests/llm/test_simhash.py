import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boutlog.llm import simhash_dedup

RND = random.Random(8)


def print_of(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """fingerprint -> a representative of its component, by all pairs."""
    f = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(f))
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= 3) for x in f]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(f.tolist(), label.tolist()))
        label = new


def test_equals_brute_force(spark):
    words = ["w%d" % i for i in range(300)]
    base = [RND.choice(words) for _ in range(150)]
    texts = [None, "", " \n\t", "one", "One two", "one TWO", "a b c", "a b c a b c a b c", "Ünï cödé wörds äre fine", "x" * 30_000, " ".join(base * 500)]
    for i in range(200):  # a family of edited copies, and texts of their own
        now = list(base)
        for _ in range(RND.randrange(4)):
            now[RND.randrange(150)] = RND.choice(words)
        texts += [" ".join(now).title() if i % 3 else " ".join(now), " ".join(RND.choice(words) for _ in range(40))]
    texts += [" ".join(base)] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"fp": F.lit("own"), "grp": F.lit(1), "component_id": F.lit("x"), "id": F.lit(0)}).repartition(5)
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(df).collect()}
    prints = [print_of(t) for t in texts]
    part = brute_components(prints)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(part[p], i)
    assert len(got) == len(texts)
    for i, p in enumerate(prints):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", least[part[p]])


@pytest.mark.parametrize("group", [2, 5, 256])
def test_links_of_dense_fingerprints(spark, group):
    """Families within a few bits of one another, so that groups are cut again down to the last bits."""
    prints = set()
    for _ in range(6):
        centre = RND.getrandbits(64)
        bits = RND.sample(range(64), 14)
        for _ in range(200):
            x = centre
            for b in RND.sample(bits, RND.randrange(8)):
                x ^= 1 << b
            prints.add(x)
    prints |= {RND.getrandbits(64) for _ in range(100)}
    low = RND.getrandbits(64) & ~0x3FF
    prints |= {low | i for i in range(0, 1024, 3)}
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    found = simhash_dedup.links(spark.createDataFrame(signed, "fp long"), group=group).collect()
    part, parent = brute_components(prints), {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ((int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in found):
        assert 0 < (a ^ b).bit_count() <= 3
        parent[find(a)] = find(b)
    pairs = {(part[p], find(p)) for p in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_nulls_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, None), (4, ""), (4, ""), (2, "a b c d"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    zero, p = "0" * 16, f"{print_of('a b c d'):016x}"
    assert got == sorted([(None, p, 2), (2, p, 2), (None, zero, 4), (4, zero, 4), (4, zero, 4), (9, zero, 4)], key=str)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    alone = simhash_dedup.near_duplicates(docs.where("doc_id IS NULL AND text IS NOT NULL")).collect()
    assert [r.component_id for r in alone] == [None]
