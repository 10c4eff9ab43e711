import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutlog.operators import recursive
from boutlog.operators.recursive import Average

RND = random.Random(6)


def history(n, players=3):
    rows = []
    for i in range(n):
        p = RND.choice(["a", "a", "b", "c"][: players + 1])
        defined = p != "c" or i % 40 == 0  # of c, whole blocks have no defined value
        rows.append((i, dt.date(2000, 1, 1) + dt.timedelta(days=i // 3), p, RND.choice(["Clay", "Grass", "Sand"]), RND.random() if defined and i % 7 else None, float(RND.randrange(2))))
    return rows


def loops(rows, specs, key):
    """match_num -> values of the averages before the match, by a plain loop."""
    state, seen, out = {}, {}, {}
    for i, _, p, s, v, w in rows:
        out[i] = {}
        for name, value, prior, alpha, unseen in specs:
            k = (p, s, name) if key else (p, name)
            now = state.get(k, prior)
            out[i][name] = unseen if unseen is not None and not seen.get(k) else now
            x = v if value == "v" else w
            if x is not None:
                state[k], seen[k] = alpha * x + (1 - alpha) * now, True
    return out


@pytest.mark.parametrize("block", [1, 4, 64, 512])
@pytest.mark.parametrize("key", [False, True])
def test_averages_equal_a_loop(spark, block, key):
    rows = history(1500)
    specs = [("short", "v", 0.3, 0.18, None), ("long", "v", 0.9, 0.05, None), ("wins", "w", 0.5, 0.18, -1.0), ("fast", "v", 0.0, 0.27, None)]
    view = spark.createDataFrame(rows, "match_num long, tourney_date date, player string, surface string, v double, w double").repartition(3)
    averages = [Average(v, p, n, a, None if u is None else F.lit(u)) for n, v, p, a, u in specs]
    got = recursive.with_averages(view, averages, ("surface",) if key else (), block)
    assert got.columns == [*view.columns, *[s[0] for s in specs]]
    want = loops(rows, specs, key)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        for name in want[r.match_num]:
            assert abs(r[name] - want[r.match_num][name]) < 1e-9, (r.match_num, name)


def test_null_keys_and_empty_views(spark):
    schema = "match_num long, tourney_date date, player string, surface string, v double, w double"
    day = dt.date(2000, 1, 1)
    view = spark.createDataFrame([(1, day, None, "Clay", 1.0, 1.0), (2, day, "a", None, 1.0, 1.0), (3, day, "a", "Clay", 1.0, 1.0)], schema)
    assert {r.match_num: r.e for r in recursive.with_averages(view, [Average("v", 0.5, "e")], ("surface",)).collect()} == {1: None, 2: None, 3: 0.5}
    assert recursive.with_averages(view.limit(0), [Average("v", 0.5, "e")]).count() == 0
    with pytest.raises(ValueError):
        recursive.with_averages(view, [Average("v", 0.5, "e", 0.6)], block=4096)


def test_sorts_do_not_grow_with_averages(spark):
    view = spark.createDataFrame(history(20), "match_num long, tourney_date date, player string, surface string, v double, w double")
    plans = [recursive.with_averages(view, [Average("v", 0.5, f"e{i}", 0.1 + i / 100) for i in range(n)])._jdf.queryExecution().executedPlan().toString() for n in (1, 12)]
    assert plans[0].count("Sort [") == plans[1].count("Sort [")
