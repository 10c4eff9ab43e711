import datetime as dt
import warnings

import duckdb
import pytest
from pyspark.sql import functions as F

from boutlog import ingest, registry  # noqa: F401
from boutlog.operators import market_feed
from boutlog.sources import match_log as source
from boutlog.sources.feeds import Feed, read_feed, read_years
from boutlog.streaming import upserts
from tests.test_library import SF, rows

FEED = Feed({"k": "string", "n": "int", "day": "date", "price": "double", "note": "string"}, "k", {"old_price": "price"})


@pytest.mark.parametrize("name", ["odds_feed", "odds_cascade_five", "incremental_upsert"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, wanted = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_columns_drift(spark, tmp_path):
    (tmp_path / "f_2001.csv").write_text('﻿k,n,day,old_price,gone\na,7.0,20010203,1.5,x\n"b, c",x,2001-02-04,,y\nshort,1\n')
    (tmp_path / "f_2002.csv").write_text('price,note,"k",day,n\n2.5,"say ""hi"", you",d,2002-01-05,8\n\n2.5,,e,yesterday,9,more\n')
    (tmp_path / "f_2003.csv").write_text("k,n\n")
    (tmp_path / "f_2004.csv").write_text("x,1\n")
    (tmp_path / "f_2005.csv").write_text("")
    got = {(r.season, r.k): r for r in read_feed(spark, [str(tmp_path)], FEED, corrupt="bad").collect()}
    a, b, d, e, x = (got[k] for k in ((2001, "a"), (2001, "b, c"), (2002, "d"), (2002, "e"), (2004, None)))
    assert (a.n, a.day, a.price, a.note, a.bad) == (7, dt.date(2001, 2, 3), 1.5, None, None)
    assert (b.n, b.day, b.price) == (None, dt.date(2001, 2, 4), None)
    assert (d.n, d.day, d.price, d.note) == (8, dt.date(2002, 1, 5), 2.5, 'say "hi", you')
    assert e.bad == "2.5,,e,yesterday,9,more" and e.day is None and x.bad == "x,1"
    assert got[(2001, "short")].bad == "short,1" and len(got) == 6
    some = read_feed(spark, [str(tmp_path / "f_2001.csv")], FEED, ["price", "k"])
    assert some.columns == ["price", "k", "season"] and some.count() == 3
    with pytest.raises(FileNotFoundError):
        read_feed(spark, [str(tmp_path / "f_2001.csv"), str(tmp_path / "f_1999.csv")], FEED)


def test_files_per_year(spark, tmp_path):
    folder = tmp_path / "x_1234"
    folder.mkdir()
    for y in (2001, 2003):
        (folder / f"f_{y}.csv").write_text(f"k,n\nk{y},{y}\n")
    with pytest.warns(UserWarning, match=r"\[2002\]"):
        out = read_years(spark, str(folder), "f_{year}.csv", [2001, 2002, 2003], FEED, required=False)
    assert {(r.season, r.k) for r in out.collect()} == {(2001, "k2001"), (2003, "k2003")}
    with pytest.raises(FileNotFoundError):
        read_years(spark, str(folder), "f_{year}.csv", [2001, 2002], FEED)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert read_years(spark, str(folder), "f_{year}.csv", [2001], FEED, required=False).count() == 1
    with pytest.warns(UserWarning):
        assert source.read_seasons(spark, str(folder), [1900], required=False).count() == 0


def test_one_scan_for_all_files(spark, tmp_path):
    for y in range(2001, 2009):
        (tmp_path / f"f_{y}.csv").write_text(f"k,n,c{y % 3}\nk{y},{y},1\n")
    plan = read_feed(spark, [str(tmp_path)], FEED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_seasons_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(2001, 1), (2002, 2)], "season int, v int")
    source.write_seasons(df, str(tmp_path / "t"))
    source.write_seasons(df.withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert {(r.season, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(2001, 1), (2002, 2)}
    source.write_seasons(df.withColumn("v", F.lit(9)), str(tmp_path / "t"), "overwrite")
    assert {r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {9}


def table(spark, folder):
    return {(r.season, r.k): (r.v, r["sum"]) for r in upserts.read_table(spark, folder).collect()}


def test_a_batch_may_come_twice(spark, tmp_path):
    folder = str(tmp_path / "t")
    refresh = lambda df: df.withColumn("sum", F.coalesce("v", F.lit(0.0)) + (F.coalesce("w", F.lit(0.0)) if "w" in df.columns else 0.0))
    merge = lambda rows, schema: upserts.merge_batch(spark.createDataFrame(rows, schema), folder, "k", "season", "t", refresh)
    one = "season int, k string, v double, t int"
    first = [(1, "a", None, 1), (1, "a", 2.0, 2), (1, "a", 3.0, 3), (1, "b", None, 1), (2, "a", 5.0, 1), (None, "c", 1.0, None), (1, None, 8.0, 1)]
    for _ in range(2):
        merge(first, one)
        assert table(spark, folder) == {(1, "a"): (2.0, 2.0), (1, "b"): (None, 0.0), (2, "a"): (5.0, 5.0), (None, "c"): (1.0, 1.0)}
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "season=2").glob("*.parquet")}
    second = [(1, "b", 7.0, 1.0, 1), (1, "a", 9.0, 1.0, 1), (1, "d", None, 4.0, 1), (None, "c", None, 2.0, 1)]
    for _ in range(2):
        merge(second, "season int, k string, v double, w double, t int")
        assert table(spark, folder) == {(1, "a"): (2.0, 3.0), (1, "b"): (7.0, 8.0), (1, "d"): (None, 4.0), (2, "a"): (5.0, 5.0), (None, "c"): (1.0, 3.0)}
    assert files == {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "season=2").glob("*.parquet")}  # a season that a batch does not touch stays
    merge([], one)
    assert len(table(spark, folder)) == 5
    assert upserts.read_table(spark, str(tmp_path / "none")) is None


def test_market_feed(spark):
    df = spark.createDataFrame([("a", 1.5, 2.5, None, None, 3.0, None), ("b", 1.5, None, 1.1, 1.2, 3.0, 4.0), ("c", None, None, None, 2.0, 1.25, 2.26)], "match_key string, EnglishAvg_winner double, EnglishAvg_loser double, B365_winner double, B365_loser double, STS_winner double, STS_loser double")
    assert {r.match_key: (r.odds_w, r.odds_l) for r in market_feed.pairs(df).collect()} == {"a": (1.5, 2.5), "b": (1.1, 1.2), "c": (1.25, 2.26)}
    got = {r.match_key: r for r in market_feed.with_averages(df).collect()}
    assert got["c"].PolishAvg_winner == 1.25 and got["c"].AllAvg_loser == 2.13 and got["a"].PolishAvg_loser is None
    ids = spark.createDataFrame([("x", 2, 1), ("x", 1, 2), (None, 3, 3), (None, 4, 4)], "be_match_id string, match_num int, tourney_date int")
    assert {r.match_num: r.be_match_id for r in market_feed.one_use(ids).collect()} == {2: "x", 1: None, 3: None, 4: None}
