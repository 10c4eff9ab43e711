import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from boutlog import experiments, registry
from boutlog.operators import checks, evaluation, history, ordering, reshape, venue
from boutlog.plans import models
from tests.test_library import SF

RND = random.Random(9)


@pytest.fixture(scope="module")
def sample(spark):
    data = []
    for i in range(300):
        for y in (1, 0):
            data.append((i, f"{1990 + i // 50}-01-{1 + i % 28:02d}", y, RND.gauss(y, 1.0), RND.random(), float(RND.randrange(6))))
    return spark.createDataFrame(data, "match_num long, d string, y int, x1 double, x2 double, code double").withColumn("tourney_date", F.to_date("d")).withColumn("season", F.year("tourney_date")).cache()


def test_smoothed_calibration_equals_newton(spark):
    rows = [(min(1.0, max(0.0, 0.5 + 0.25 * (y - 0.5) + RND.gauss(0, 0.2))), y) for y in [1] * 40 + [0] * 65]
    n1, n0 = 40, 65
    a = b = 0.0
    for _ in range(60):
        ga = gb = haa = hab = hbb = 0.0
        for p, y in rows:
            t = (n1 + 1) / (n1 + 2) if y else 1 / (n0 + 2)
            q = 1 / (1 + math.exp(-(a * p + b)))
            ga, gb = ga + (q - t) * p, gb + (q - t)
            w = q * (1 - q)
            haa, hab, hbb = haa + w * p * p, hab + w * p, hbb + w
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    curve = models.sigmoid(spark.createDataFrame(rows, "p double, y int")).stages[-1]
    assert abs(curve.coefficients[0] - a) < 1e-5 and abs(curve.intercept - b) < 1e-5


def test_categories_are_split_as_sets(spark):
    data = [(i, float(i % 6), RND.random(), int(i % 6 in (0, 2, 5))) for i in range(600)]  # no single cut of the code's order separates
    df = spark.createDataFrame(data, "match_num long, code double, x double, y int")
    kind = models.forest(1, 1, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=False)
    right = lambda m: models.predict(m, df).where((F.col("p") > 0.5).cast("int") == F.col("y")).count() / 600
    as_set, as_number = models.fit(df, kind, ["code", "x"], ["code"]), models.fit(df, kind, ["code", "x"])
    assert right(as_set) == 1.0 and right(as_number) < 0.9
    assert "in {" in as_set.stages[-1].toDebugString and "in {" not in as_number.stages[-1].toDebugString
    boosted = models.fit(df, models.boosting(2, 1), ["code", "x"], ["code"])
    assert right(boosted) == 1.0 and "in {" in boosted.stages[-1].toDebugString
    unseen = df.limit(3).withColumn("code", F.lit(77.0))
    assert models.predict(as_set, unseen).count() == 3


def test_folds_by_place(spark, sample):
    tagged = models.folded(sample, 5).toPandas()
    sizes = tagged.groupby("fold").match_num.nunique()
    assert list(sizes) == [50] * 6 and (tagged.groupby("match_num").fold.nunique() == 1).all()
    order = tagged.sort_values(["tourney_date", "match_num"]).drop_duplicates("match_num").fold
    assert order.is_monotonic_increasing
    few = reshape.expanding_folds(sample.where("y = 1").limit(4))
    assert {r.fold for r in few.collect()} == {0}
    assert reshape.expanding_folds(sample.limit(0)).count() == 0


def test_search_refits_the_chosen_one(spark, sample, tmp_path):
    space = {"numTrees": (2, 3), "maxDepth": (1, 3), "minInstancesPerNode": (1, 40), "featureSubsetStrategy": ("sqrt",), "bootstrap": (True,), "subsamplingRate": (0.8,), "impurity": ("gini",)}
    draws = models.drawn(6, space=space)
    assert len(draws) == 6 and list(draws) == list(models.drawn(6, space=space)) and len(models.drawn(50)) == 50 and len(models.drawn(99, space=space)) == 8
    table, name, model = models.search(sample, draws, ["x1", "x2"], folds=3, save_to=str(tmp_path / "m"))
    rows = table.collect()
    assert [(r.setting, r.fold) for r in rows] == [(n, k) for n in draws for k in (1, 2, 3)]  # in this order, whichever ended first
    alone = models.read_out(sample, draws, ["x1", "x2"], folds=3, at_once=1).collect()
    assert rows == alone
    means = {n: sum(r.log_loss for r in rows if r.setting == n) / 3 for n in draws}
    assert name == min(means, key=lambda n: (means[n], n))
    again = models.predict(PipelineModel.load(str(tmp_path / "m")), sample).agg(F.sum("p")).first()[0]
    assert again == models.predict(model, sample).agg(F.sum("p")).first()[0]
    assert all(0.5 < r.auc <= 1 and r.n == 150 for r in rows)


def test_metrics_predict_once(spark):
    rows = [(i % 7 / 7 if i % 5 else float(i % 2), int(RND.random() < 0.4)) for i in range(500)]
    calls = spark.sparkContext.accumulator(0)

    def seen(p):
        calls.add(1)
        return p

    got = models.metrics_of(spark.createDataFrame(rows, "p double, y int").withColumn("p", F.udf(seen, "double")("p")))
    clip = lambda p: min(1 - 1e-15, max(1e-15, p))
    pairs = [(p, q) for p, y in rows for q, z in rows if y == 1 and z == 0]
    want = {"n": 500, "accuracy": sum((p > 0.5) == y for p, y in rows) / 500, "brier": sum((p - y) ** 2 for p, y in rows) / 500, "log_loss": -sum(math.log(clip(p) if y else 1 - clip(p)) for p, y in rows) / 500, "auc": sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert calls.value == 500  # 2,000 and more before: each metric's pass predicted again


def test_vectors_are_assembled_once_for_all_fits(spark, sample, monkeypatch):
    made = []
    real = models.VectorAssembler
    monkeypatch.setattr(models, "VectorAssembler", lambda **k: made.append(k["inputCols"]) or real(**k))
    models.read_out(sample, {"a": models.forest(2, 1), "b": models.boosting(2, 2), "c": models.logistic()}, ["x1", "x2"], folds=2)
    assert made == [["x1", "x2"]]  # 6 before, one a fit


def test_walk_forward_takes_all_seasons_but_the_first(sample):
    walked = models.walk_forward(sample, experiments._seasons(sample), {"a": models.Variant(["x1"], models.forest(3, 2)), "b": models.Variant(["x1", "code"], models.forest(3, 2), ["code"])})
    assert {(r.season, r.variant) for r in walked.select("season", "variant").distinct().collect()} == {(s, v) for s in range(1991, 1996) for v in "ab"}


def test_mean_rank(spark):
    t = lambda *rows: spark.createDataFrame(rows, "feature string, importance double, rank int")
    got = {r.feature: (r.mean_rank, r.mean_importance) for r in models.mean_rank([t(("a", 0.7, 1), ("b", 0.3, 2)), t(("b", 0.6, 1), ("a", 0.4, 2))]).collect()}
    assert {f: (r, round(v, 9)) for f, (r, v) in got.items()} == {"a": (1.5, 0.55), "b": (1.5, 0.45)}


def test_variant_lists():
    sizes = {v: len(experiments.variant_features(v)) for v in history.VARIANTS}
    assert sizes == {"sliceaware": 73, "bestof5": 79, "qfserve": 100} and len(models.FEATURES) == 40 and len(models.FEATURES_17) == 17
    assert [len(f) for f in experiments.NESTED.values()] == [9, 3, 2, 1]


def test_pace_knows_earlier_seasons_only(spark):
    log = registry.matches_of(spark, SF)
    got = {(r.season, r.base, r.surface): r.court_pace for r in venue.pace_before(log, support=3).collect()}
    rows = log.select("season", F.substring("tourney_id", 6, 99).alias("base"), "surface", (F.col("w_ace") + F.col("l_ace")).alias("ace"), (F.col("w_svpt") + F.col("l_svpt")).alias("svpt")).toPandas()
    rows = rows[rows.svpt > 0]
    for (season, base, surface), pace in got.items():
        past = rows[rows.season < season]
        if past.empty:
            assert pace is None
            continue
        by = past.groupby(["base", "surface"]).agg(ace=("ace", "sum"), svpt=("svpt", "sum"), n=("ace", "size"))
        by = (by.ace / by.svpt)[by.n >= 3]
        mean, std = past.ace.sum() / past.svpt.sum(), by.std()
        std = std if std > 0 else venue.STD_DEFAULT
        own = past[past.surface == surface]
        value = by.get((base, surface), own.ace.sum() / own.svpt.sum() if len(own) else mean)
        assert abs(pace - (value - mean) / std) < 1e-9
    assert venue.with_pace_before(log).count() == log.count()


def test_checks_raise_with_examples(spark):
    df = spark.createDataFrame([(i, f"{2000 + i}-A" if i % 10 else f"bad{i}", 1.0 * (i % 2)) for i in range(100)] + [(999, None, None)], "k int, tourney_id string, v double")
    ids = [checks.format_check("tourney_id"), checks.Check("small", F.col("k") > 1000, F.col("k"))]
    ok = checks.checked(df.where("k % 10 <> 0"), ids, [checks.MeanCheck("m", "v", 50 / 90)])
    assert ok.count() == 91  # null ids are fine
    with pytest.raises(checks.Violation, match="^format of tourney_id: .'bad0', 'bad10', 'bad20', 'bad30', 'bad40'.$"):
        checks.checked(df, ids)
    with pytest.raises(checks.Violation, match="is 0.5, 0.6 was"):
        checks.checked(df, means=[checks.MeanCheck("m", "v", 0.6)])
    with pytest.raises(checks.Violation):
        checks.checked(df.limit(0), means=[checks.MeanCheck("m", "v", 0.6)])
    assert checks.checked(df.limit(0), ids, [checks.MeanCheck("m", "v", None)]).count() == 0
    assert [(r.value, r.n) for r in checks.violations(df, checks.format_check("tourney_id"), 3).collect()] == [("bad0", 1), ("bad10", 1), ("bad20", 1)]


def test_unequal_slices_are_an_error(spark):
    t = lambda *rows: spark.createDataFrame(rows, "slice string, degree int, support long, accuracy double")
    a, b = t(("x=1", 1, 5, 0.5), ("x=2", 1, 6, 0.5)), t(("x=1", 1, 5, 0.7), ("x=2", 1, 6, 0.4))
    assert {(r["slice"], r.kind) for r in evaluation.gains_and_losses(evaluation.compare_slices({"a": a, "b": b}, "a"), "b_delta", 1).collect()} == {("x=1", "gain"), ("x=2", "loss")}
    with pytest.raises(Exception, match="some models lack: x=2"):
        evaluation.compare_slices({"a": a, "b": b.where("slice = 'x=1'")}, "a").collect()


def test_encoding_of_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "v string")
    codes = reshape.fitted_codes(train, "v")
    assert {r.value: r.code for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    some = spark.createDataFrame([(1, "c"), (2, "zz"), (3, None), (4, "a")], "k int, v string")
    assert {r.k: r.n for r in reshape.apply_codes(some, codes, "v", "n").collect()} == {1: 2, 2: 0, 3: 0, 4: 0}
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_places(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)] + [(None, 500)], "a int, b int")
    for n in (1, 4, 23):
        got = ordering.numbered(df.repartition(n), [F.col("a").desc(), "b"]).collect()
        want = sorted(((r.a, r.b) for r in got), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(201))
    assert ordering.numbered(df.limit(0), ["a"]).count() == 0
    one, two = ({(r.a, r.b): r.place for r in ordering.shuffled(df.repartition(n), ["a", "b"]).collect()} for n in (1, 9))
    other = {(r.a, r.b): r.place for r in ordering.shuffled(df, ["a", "b"], seed=7).collect()}
    assert one == two != other and sorted(other.values()) == list(range(201))
