"""Averages of all keys from one ordered pass: the log is read once, and nothing depends on where batches end."""

import datetime as dt
import random

from pyspark.sql import functions as F

from boutlog import registry
from boutlog.operators import recursive
from boutlog.operators.recursive import Average

SF = "/root/testdata/sf0.001"


def test_the_log_is_read_once(spark):
    for name in ("dual_horizon_48", "ewma_momentum", "ewma_form", "dual_horizon_form"):
        df = registry.QUERIES[name](spark, SF)
        scans = df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
        assert scans == 2, (name, scans)  # lineitem and orders


def test_states_pass_over_batches_by_key(spark):
    rnd = random.Random(8)
    rows = [(i, dt.date(2000, 1, 1) + dt.timedelta(days=i // 5), rnd.choice("abbbb"), rnd.choice(["x", "y", None]), rnd.choice([None, 1.5, -2.0, float("inf") if i == 600 else 0.25])) for i in range(900)]
    view = spark.createDataFrame(rows, "match_num long, tourney_date date, player string, surface string, v double")
    averages = [Average("v", 0.5, "all_", 0.2), Average("v", 0.1, "of_", 0.3, F.col("all_"), ("surface",))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.match_num: r for r in recursive.with_averages(view, averages, block=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    state = {}
    for i, _, p, s, v in rows:
        one = state.get(p, 0.5)
        two = None if s is None else state.get((p, s), one)
        for have, want in ((got[i].all_, one), (got[i].of_, two)):
            assert have == want or abs(have - want) < 1e-9, (i, have, want)
        if v is not None:
            state[p] = 0.2 * v + 0.8 * one
            if s is not None:
                state[p, s] = 0.3 * v + 0.7 * state.get((p, s), 0.1)


def test_half_up_equals_decimals(spark):
    rnd = random.Random(9)
    values = [None, float("nan"), -0.0, 1e-9, -5e-7, 5e-7, 0.1234565, -0.1234565, 0.00000049995, 3e7, -2.5e12, *(rnd.uniform(-9, 9) for _ in range(300)), *(rnd.randrange(-(10**7), 10**7) / 2e6 for _ in range(300))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    same = registry.half_up(df).join(df.select("i", (F.floor(F.round(F.col("x") * 1_000_000, 4) + 0.5) / 1_000_000).alias("y")), "i")
    assert same.where("x is distinct from y").collect() == []
