import math
import random

from pyspark.sql import functions as F

from boutlog.llm import quality_rules as rules
from boutlog.session import stored

RND = random.Random(8)
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(n, marks=0, upper=0):
    words = ["w%d" % RND.randrange(5000) for _ in range(n)]
    for k in RND.sample(range(n), marks):
        words[k] += "#"
    for k in RND.sample(range(n), upper):
        words[k] = words[k].upper()
    return " ".join(words)


def test_thresholds_and_verdicts_by_brute_force(spark):
    data = []
    for lang, source, n in (("en", "web", 80), ("en", None, 60), (None, "web", 45), ("en", "tiny", 5), ("xx", "alone", 3)):
        for _ in range(n):
            data.append((len(data), prose(RND.randrange(60, 200), RND.choice([0] * 20 + [1] * 4 + [2] * 2 + [40]), RND.randrange(0, 30)), lang, source))
    data += [(900, None, "en", "web"), (901, "", "en", "web"), (902, "# " * 400, None, None), (None, prose(100), "en", "web"), (0, data[0][1], "en", "web")]
    measured = stored(rules.measure(spark.createDataFrame(data, SCHEMA).withColumns({"kept": F.lit("own"), "n_lines": F.lit(-1)})))
    limits = {(r["_lang"], r["_source"]): r for r in rules.thresholds(measured).collect()}
    rows = rules.judge(measured, rules.thresholds(measured)).collect()
    assert len(rows) == len(data)
    passed = [r for r in rows if not r.base_failed]

    def high(values, q):
        x = sorted(values)[math.ceil(q * len(values)) - 1]
        return 0.0 if x <= 0 else rules.GROWTH ** (math.floor(math.log(x) / math.log(rules.GROWTH)) + 1)

    for r in rows:
        if r.base_failed:
            assert not r.kept
            continue
        own = [x for x in passed if (x.lang, x.source) == (r.lang, r.source)]
        group = own if len(own) >= rules.MIN_ROWS else [x for x in passed if x.lang == r.lang]
        group = group if len(group) >= rules.MIN_ROWS else passed
        within = True
        for m, (of, step) in rules.FLOORS.items():
            mid, top = high([x[m] for x in group], rules.MIDDLE), high([x[m] for x in group], rules.HIGH)
            t = limits[r.lang, r.source][f"t_{m}"]
            assert math.isclose(t.middle, mid) and math.isclose(t.high, top)
            within &= r[m] <= top + rules.SPREAD * max(top - mid, step / max(1, r[of]))
        assert r.kept == within
    assert 0 < sum(r.kept for r in passed) < len(passed)
