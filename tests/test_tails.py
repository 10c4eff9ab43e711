"""Contexts of the last matches come from one pass; they equal the windows, wherever batches and chunks end."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutlog import registry
from boutlog.operators import history, tails

SF = "/root/testdata/sf0.001"


def test_contexts_are_one_pass(spark):
    plan = history.extended(registry.matches_of(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ignore nulls") + plan.count("IGNORE NULLS") == 0 and plan.count("lag(_v") == 10  # over a hundred lags before
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("rows", [1, 7, 1 << 14])
def test_equals_windows(spark, monkeypatch, rows):
    monkeypatch.setattr(tails, "ROWS", rows)
    rnd = random.Random(rows)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randrange(200))
    data = [(i, day(), rnd.choice("aabc"), rnd.choice(["x", "y", None]), rnd.choice(["L", "R"]), rnd.choice([3, 5, 5, None]), rnd.choice([None, 1.5, -0.25, 100.0]), float(rnd.randrange(2))) for i in range(500)]
    view = spark.createDataFrame(data, "match_num long, tourney_date date, player string, surface string, opp_hand string, best_of long, minutes double, is_win double").repartition(2, "player")
    measures = {"n": history.Measure("count"), "m": history.Measure("count", "minutes"), "a": history.Measure("mean", "minutes"), "d": history.Measure("deviation", "minutes"), "w": history.Measure("mean", "is_win")}
    contexts = [history.Context(c, keys, n) for c, n in (("true", 4), ("best_of = 5", 3), ("best_of = 5 AND minutes >= 90", 20), ("best_of = 4", 2)) for keys in ((), ("surface",), ("opp_hand", "surface"))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        made = tails.tails(view, [(c, [(m.kind, m.value) for m in measures.values()]) for c in contexts])
        assert made.columns[: len(view.columns)] == view.columns
        got = {r.match_num: r for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 500
    for c in contexts:
        for r in history.tail(view, c, **measures).collect():
            for name, m in measures.items():
                have, want = got[r.match_num][tails.known(c, m.kind, m.value)], r[name]
                if name in "nm":
                    have, want = have or 0, want or 0
                assert have == want or (have is not None and want is not None and have == pytest.approx(want, abs=1e-9)), (c, name, r.match_num, have, want)


def test_measures_at_hand_are_taken(spark):
    context = history.Context("best_of = 5", (), 3)
    view = spark.range(3).select(F.col("id").alias(tails.known(context, "count", None)))
    assert [r.k for r in history.tail(view, context, k=history.Measure("count")).orderBy("k").collect()] == [0, 1, 2]


def test_nothing_to_read(spark):
    empty = history.player_view(registry.matches_of(spark, SF).limit(0))
    assert history.tails(empty, [(history.Context("best_of = 5"), [("mean", "is_win")])]).count() == 0
