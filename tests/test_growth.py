"""Work on rows must not grow with the square of them: what is checked is the number of rows that the jobs move."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutlog import registry
from boutlog.operators import history, resolution
from boutlog.plans import models

DAY = dt.date(2001, 3, 1)


def copies(spark, n):
    """n matches of the same two names on the same day, and as many feed rows, ranks different."""
    m = spark.range(n).select(F.col("id").alias("match_num"), F.lit(DAY).alias("tourney_date"), F.lit("Ann Moss").alias("w_name"), F.lit("Bea Lee").alias("l_name"), (F.col("id") % 7).cast("int").alias("w_rank"), (F.col("id") % 5).cast("int").alias("l_rank"))
    f = spark.range(n).select((F.col("id") + 10**6).alias("feed_id"), F.date_add(F.lit(DAY), (F.col("id") % 9).cast("int")).alias("feed_date"), F.lit("Moss A.").alias("w_short"), F.lit("Lee B.").alias("l_short"), (F.col("id") % 7).cast("int").alias("w_rank"), (F.col("id") % 4).cast("int").alias("l_rank"))
    return m, f


def test_serving_in_turn_equals_rounds_over_pairs(spark):
    rnd = random.Random(11)
    day = lambda *r: DAY + dt.timedelta(days=rnd.randrange(*r))
    name = lambda: f"{rnd.choice(['Ann', 'Bea', 'Cid'])} {rnd.choice(['Moss', 'Lee', 'de la Kay'])}"
    rank = lambda: rnd.choice([None, 1, 2, 3])
    short = lambda: f"{rnd.choice(['Moss', 'Lee', 'Kay', 'de la Kay'])} {rnd.choice('ABC')}."
    m = spark.createDataFrame([(i, day(70), name(), name(), rank(), rank()) for i in range(150)], "match_num long, tourney_date date, w_name string, l_name string, w_rank int, l_rank int")
    f = spark.createDataFrame([(500 + i, day(-5, 90), short(), short(), rank(), rank()) for i in range(130)], "feed_id long, feed_date date, w_short string, l_short string, w_rank int, l_rank int")
    kept = lambda df: sorted(tuple(r) for r in df.select("match_num", "feed_id", "agreement", "day_gap").collect())
    assert kept(resolution.match_once(m, f)) == kept(resolution.assign_once(resolution.candidates(m, f)))


@pytest.mark.parametrize("fallback", [False, True])
def test_one_use_does_not_make_all_pairs(spark, fallback):
    n = 20_000  # 400 million pairs
    got = resolution.match_once(*copies(spark, n), fallback=fallback).collect()
    assert len(got) == n == len({r.feed_id for r in got}) == len({r.match_num for r in got})


def test_either_way_does_not_make_all_pairs(spark):
    n = 20_000
    a = spark.range(n).select("id", F.lit(DAY).alias("day"), F.lit("Ann Moss").alias("n1"), F.lit("Bea Lee").alias("n2"))
    one = spark.createDataFrame([(-1, DAY, "Cid Kay", "Dan Poe")], "id long, day date, n1 string, n2 string")
    b = a.select((F.col("id") + 10**6).alias("other"), "day", F.col("n2").alias("n1"), F.col("n1").alias("n2"))
    got = resolution.unique_either_way(a.unionByName(one), b.unionByName(one.select((F.col("id") - 6).alias("other"), "day", F.col("n2").alias("n1"), F.col("n1").alias("n2")))).collect()
    assert [tuple(r) for r in got] == [(-1, -7)]


def test_context_features_sort_once_for_each_key_set(spark):
    # the plan that Spark prepares, with adaptive execution's own part left out
    plan = history.extended(registry.matches_of(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [player") <= 10  # one for each of six key sets, and the orders of matches; 40 and more before


def test_parts_follow_the_input(spark, tmp_path):
    from boutlog.session import dealt

    spark.range(300_000).repartition(1).write.parquet(str(tmp_path / "a b"))
    df = spark.read.parquet(str(tmp_path / "a b"))
    few, many = (dealt(df, "id", part_bytes=n).rdd.getNumPartitions() for n in (1 << 20, 1 << 16))
    assert many > 8 * few


def test_fewer_fits_run_at_once_on_more_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_AT_ONCE", 1000)
    assert [models.fits_at_once(spark.range(n)) for n in (0, 10, 300, 5000)] == [8, 8, 3, 1]


def test_recent_means_are_in_methods_that_are_compiled(spark):
    # arrays of earlier matches were filtered and summed by interpreted lambdas; one method over all lags is over what HotSpot compiles
    plan = history.with_serve(history.with_form(history.player_view(registry.matches_of(spark, "/root/testdata/sf0.001"))))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_recent_means_equal_a_loop(spark):
    rnd = random.Random(5)
    start = dt.date(2000, 1, 1)
    days = sorted(start + dt.timedelta(days=rnd.choice([0, 3, 120, 400]) + rnd.randrange(1500)) for _ in range(60))
    made = [(i, d, "P", rnd.choice(["Clay", "Hard"]), float(rnd.randrange(2)), *(rnd.choice([None, rnd.random()]) for _ in history.SHARES)) for i, d in enumerate(days)]
    view = spark.createDataFrame(made, "match_num long, tourney_date date, player string, surface string, is_win double, " + ", ".join(f"{s} double" for s in history.SHARES))
    got = history.with_surface_form(history.with_serve(history.with_form(view))).orderBy("match_num").collect()

    def mean(values, empty):
        values = [v for v in values if v is not None]
        return sum(values) / len(values) if values else empty

    for i, r in enumerate(got):
        recent = lambda rows: [x for x in rows[-10:] if x[1] >= r.tourney_date - dt.timedelta(days=365)]
        all_, there = recent(made[:i]), recent([x for x in made[:i] if x[3] == r.surface])
        assert r.form == mean([x[4] for x in all_], 0.5)
        assert r.surface_form == (mean([x[4] for x in there], None) if len(there) >= 3 else r.form)
        assert [r[f"avg_{s}"] for s in history.SHARES] == pytest.approx([mean([x[5 + j] for x in all_], history.SERVE_PRIORS[s]) for j, s in enumerate(history.SHARES)], abs=1e-15)
