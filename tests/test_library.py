import datetime as dt
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutlog import registry
from boutlog.functions import columns
from boutlog.operators import evaluation, history, recursive, reshape, resolution
from boutlog.sources import match_log as source

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df.toPandas() if hasattr(df, "toPandas") else df
    text = lambda v: "null" if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else v if isinstance(v, str) else f"{float(v):.5f}"
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["match_log", "form_last10_365d", "qf_surface_form", "rest_days", "tourney_path", "ewma_surface_form", "best_candidate", "slices_1d_2d", "reliability", "walkforward_by_year"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, wanted = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.fixture(scope="module")
def log(spark):
    out = registry.matches_of(spark, SF).cache()
    out.count()
    return out


def test_later_matches_do_not_matter(spark, log):
    cut = dt.date(1996, 6, 1)
    f = lambda m: rows(recursive.with_ewma_form(history.with_h2h(history.with_form(history.player_view(m)))).where(F.col("tourney_date") < F.lit(cut)).select("match_num", "side", "form", "h2h", "ewma_form"))
    changed = log.withColumn("w_sid", F.when(F.col("tourney_date") >= F.lit(cut), F.col("w_sid") + 1).otherwise(F.col("w_sid")))
    assert f(log) == f(changed)


def test_swapping_sides_negates(log):
    s = registry.rounded(registry._small(log)).toPandas()
    both = s[s.y == 1].merge(s[s.y == 0], on="match_num")
    assert (both.rank_log_diff_x + both.rank_log_diff_y).abs().max() < 1e-9 and (both.p1_h2h_x + both.p1_h2h_y == 0).all() and (both.p1_form_x == both.p2_form_y).all()


def test_ewma_over_long_history(spark):
    n = 3000
    data = [(i, dt.date(2000, 1, 1) + dt.timedelta(days=i), 1, None if i % 7 == 0 else float(i % 5)) for i in range(n)]
    view = spark.createDataFrame(data, "match_num long, tourney_date date, player long, v double")
    got = {r[0]: r[1] for r in recursive.with_ewma(view, "v", F.lit(0.5), "e").select("match_num", "e").collect()}
    state = 0.5
    for i, _, _, v in data:
        assert abs(got[i] - state) < 1e-9
        if v is not None:
            state = 0.18 * v + 0.82 * state


def test_elo_against_a_loop(log):
    got = {r["match_num"]: r for r in recursive.elo(log).collect()}
    rating, played = {}, {}
    for r in log.orderBy("tourney_date", "match_num").collect():
        for kind, a, b in ((None, "w_elo", "l_elo"), (r["surface"], "w_surface_elo", "l_surface_elo")):
            w, l = (r["w_sid"], kind), (r["l_sid"], kind)  # noqa: E741
            x, y = rating.get(w, 1500.0), rating.get(l, 1500.0)
            assert math.isclose(got[r["match_num"]][a], x) and math.isclose(got[r["match_num"]][b], y)
            e = 1 / (1 + 10 ** ((y - x) / 400))
            k = lambda p: 250 / (played.get(p, 0) + 5) ** 0.4
            rating[w], rating[l] = x + k(w) * (1 - e), y - k(l) * (1 - e)
            played[w], played[l] = played.get(w, 0) + 1, played.get(l, 0) + 1


def test_mcnemar_and_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (59, 61), (275, 380)], "b long, c long")
    out = df.select("b", columns.two_sided_p(columns.mcnemar_z(F.col("b"), F.col("c"))).alias("p")).collect()
    assert out[0].p == 1 and out[1].p == 1 and abs(out[2].p - 0.927) < 0.01 and out[3].p < 1e-4
    low, high = spark.range(1).select(*columns.wilson(F.lit(0), F.lit(0))).first()
    assert (low, high) == (0.0, 1.0)


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.3, 1), (0.30000000000000004, 1), (0.5, 1), (1.0, 1)], "p double, y int")
    n = [r.n for r in evaluation.reliability(df).orderBy("bin").collect()]
    assert n == [1, 0, 1, 1, 0, 1, 0, 0, 0, 1]


def test_one_lefty_is_exclusive(spark):
    df = spark.createDataFrame([("R", "U"), ("L", "R"), ("L", "L")], "w_hand string, l_hand string").withColumns({"level": F.lit("G"), "best_of": F.lit(5), "round": F.lit("F")})
    assert [r.one_lefty for r in reshape.lefty_flags(df).collect()] == [0, 1, 0]


def test_name_keys(spark):
    pairs = [("Christopher O'Connell", "O Connell C."), ("Felix Auger Aliassime", "Auger-Aliassime F."), ("Giovanni Mpetshi Perricard", "Mpetshi G."), ("Bu Yunchaokete", "Bu Y.")]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(resolution.full_name_keys(F.col("a")), resolution.short_name_keys(F.col("b"))).alias("meet"))
    assert all(r.meet for r in df.collect())


def test_each_feed_row_is_used_once(spark):
    import random

    rnd = random.Random(4)
    pairs = sorted({(rnd.randrange(40), rnd.randrange(30)) for _ in range(200)})
    data = [(m, f, rnd.randrange(3), rnd.randrange(-3, 28)) for m, f in pairs]
    got = {r.match_num: r.feed_id for r in resolution.assign_once(spark.createDataFrame(data, "match_num long, feed_id long, agreement int, day_gap int")).collect()}
    used, wanted = set(), {}
    for m in range(40):
        left = [(-a, abs(d), f) for x, f, a, d in data if x == m and f not in used]
        if left:
            wanted[m] = min(left)[2]
            used.add(wanted[m])
    assert got == wanted


def test_season_files(spark, tmp_path):
    (tmp_path / "atp_matches_2001.csv").write_text("tourney_id,tourney_date,match_num,surface,w_ace,extra\n2001-1,20010105,1,Hard,7,x\n2001-1,20010105,2,,x,y\n")
    df = source.read_seasons(spark, str(tmp_path), [2000, 2001], columns=["tourney_id", "tourney_date", "match_num", "surface", "w_ace"], required=False)
    got = df.orderBy("match_num").collect()
    assert got[0].tourney_date == dt.date(2001, 1, 5) and got[0].w_ace == 7.0 and got[1].w_ace is None and got[0].season == 2001
    assert source.clean(df, ["surface"]).count() == 1
    with pytest.raises(FileNotFoundError):
        source.read_seasons(spark, str(tmp_path), [2000])
    with pytest.raises(ValueError):
        source.clean(df, ["nothing"])
    old, new = spark.createDataFrame([(1, 5.0), (2, None)], "k long, v double"), spark.createDataFrame([(2, 7.0), (1, 6.0), (3, 8.0)], "k long, v double")
    assert {r.k: r.v for r in source.upsert(old, new, "k").collect()} == {1: 5.0, 2: 7.0, 3: 8.0}
