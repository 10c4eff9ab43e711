"""Forests of all fits share their passes: the same as a plain loop over rows, however rows are dealt, and as good as Spark ML's."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from boutlog import experiments
from boutlog.operators import evaluation
from boutlog.plans import forests, models

FEATURES = ("x1", "x2", "x3", "code")


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(700):
        for y in (1, 0):
            rows.append((i, 1990 + i % 4, y, rnd.gauss(y, 1.0), round(rnd.random(), 1), rnd.gauss(0, 1) + (y if i % 3 else 0), rnd.randrange(5)))
    return spark.createDataFrame(rows, "match_num long, season int, y int, x1 double, x2 double, x3 double, code int").cache()


def plain(rows, fit):
    """p of the fit's rows by a loop over rows, nodes and cuts; thresholds, draws and subsets are those of forests.py."""
    c, n = fit.classifier, len(fit.features)
    key = lambda r: np.array([r["key"]]).astype(np.uint32)
    train, test = [r for r in rows if r["season"] < fit.part], [r for r in rows if r["season"] == fit.part]
    cuts = {f: forests._cuts(np.array([float(r[f]) for r in train])) for f in fit.features}
    bag = forests._bag(c.getSubsamplingRate(), c.getBootstrap())
    names = {f: j for j, f in enumerate(fit.features)}

    def impurity(counts):
        total = sum(counts)
        shares = [x / total for x in counts if x]
        return -sum(p * math.log2(p) for p in shares) if c.getImpurity() == "entropy" else 1 - sum(p * p for p in shares)

    def split(here, subset):
        whole = [sum(w for r, w in here if r["y"] == y) for y in (0, 1)]
        best = (1e-12, None, None)
        for f in subset:
            for cut in cuts[fit.features[f]]:
                sides = [[sum(w for r, w in here if r["y"] == y and (r[fit.features[f]] <= cut) == side) for y in (0, 1)] for side in (True, False)]
                if all(sum(s) >= c.getMinInstancesPerNode() for s in sides):
                    gain = impurity(whole) - sum(sum(s) / sum(whole) * impurity(s) for s in sides)
                    if gain > best[0] + 1e-12:
                        best = (gain, fit.features[f], cut)
        return best

    p = [0.0] * len(test)
    for t in range(c.getNumTrees()):
        tree = forests._number("tree", c.getSeed(), t)
        bagged = [(r, int(forests._draws(key(r), tree, bag)[0]) if bag is not None else 1) for r in train]
        level = [(0, [(r, w) for r, w in bagged if w], list(range(len(test))))]
        number = 1
        for depth in range(c.getMaxDepth() + 1):
            below = []
            for node, here, tested in level:
                share = sum(w for r, w in here if r["y"] == 1) / sum(w for _, w in here)
                subset = forests._subsets(fit, t, [node], names)[0]
                _, f, cut = split(here, subset) if depth < c.getMaxDepth() and 0 < share < 1 else (0, None, None)
                if f is None:
                    for i in tested:
                        p[i] += share / c.getNumTrees()
                    continue
                for right in (False, True):
                    below.append((number, [(r, w) for r, w in here if (r[f] > cut) == right], [i for i in tested if (test[i][f] > cut) == right]))
                    number += 1
            level = below
    return {(r["match_num"], r["y"]): x for r, x in zip(test, p)}


def test_equals_a_plain_loop(sample):
    kinds = {"a": models.forest(3, 3), "b": models.forest(2, 4, seed=7, impurity="entropy", minInstancesPerNode=9, subsamplingRate=0.8), "c": models.forest(1, 2, bootstrap=False), "d": models.forest(2, 2, featureSubsetStrategy="log2", bootstrap=False, subsamplingRate=0.7)}
    fits = [forests.Fit(n, s, FEATURES if n != "b" else FEATURES[1:], c) for n, c in kinds.items() for s in (1992, 1993)]
    rows = [r.asDict() for r in sample.withColumn("key", F.xxhash64("match_num", F.col("y").cast("long"))).collect()]
    made = forests.grown(sample, "season", fits)
    got = {}
    for r in made.scored().collect():
        got.setdefault((r["name"], r.part), {})[r.match_num, r.y] = r.p
    made.close()
    assert len(got) == len(fits)
    for fit in fits:
        want = plain(rows, fit)
        assert got[fit.name, fit.part].keys() == want.keys()
        assert max(abs(got[fit.name, fit.part][k] - want[k]) for k in want) < 1e-9, fit


def test_does_not_depend_on_how_rows_are_dealt(sample):
    fits = [forests.Fit("a", 1992, FEATURES, models.forest(4, 4)), forests.Fit("b", 1993, FEATURES, models.forest(4, 4))]
    found = []
    for n in (1, 7):
        made = forests.grown(sample.repartition(n, "x1"), "season", fits)
        found.append((sorted(tuple(r) for r in made.scored().collect()), made.importances()))
        made.close()
    assert found[0] == found[1]
    assert all(abs(sum(v) - 1) < 1e-9 and len(v) == 4 for v in found[0][1])


def test_is_as_good_as_spark_ml(sample):
    made = forests.grown(sample, "season", [forests.Fit("a", 1993, FEATURES, models.forest())])
    ours = models.metrics_of(made.scored())
    made.close()
    model = models.fit(sample.where("season < 1993"), models.forest(), FEATURES)
    theirs = models.metrics_of(models.predict(model, sample.where("season = 1993")))
    assert ours["n"] == theirs["n"] == 350 and ours["auc"] > theirs["auc"] - 0.02 and ours["log_loss"] < theirs["log_loss"] + 0.02
    values = dict(zip(FEATURES, made.importances()[0]))
    assert max(values, key=values.get) == "x1" and values["x2"] < 0.2 and values["code"] < 0.2


def test_draws_follow_poisson():
    key = np.arange(1 << 18, dtype=np.uint32) * np.uint32(2654435761)
    one, two = (forests._draws(key, forests._number("tree", 42, t), forests._bag(0.8, True)) for t in (0, 1))
    n = len(key)
    for k in range(5):
        p = math.exp(-0.8) * 0.8**k / math.factorial(k)
        assert abs((one == k).mean() - p) < 6 * math.sqrt(p / n)
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.01


def test_all_fits_share_their_jobs(spark, sample, monkeypatch):
    def jobs(variants):
        tag = f"t{variants}"
        spark.sparkContext.setJobGroup(tag, tag)
        walked = models.ended(models.walk_forward(sample, experiments._seasons(sample), {f"v{i}": models.Variant(FEATURES, models.forest(2, 3, seed=i)) for i in range(variants)}))
        assert walked.count() == 525 * variants
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        spark.sparkContext.setJobGroup("", "")
        return found

    one, six = jobs(1), jobs(6)
    assert six <= one + 2  # a dozen more for each of 15 fits before


def test_fits_do_not_use_spark_ml(spark, sample, monkeypatch):
    monkeypatch.setattr(models, "fit", None)
    table = models.seed_sweep(spark, sample.where("season < 1993"), sample.where("season = 1993"), (1, 2, 3), FEATURES).collect()
    assert [r.seed for r in table] == [1, 2, 3] and len({r.brier for r in table}) == 3 and all(r.accuracy > 0.7 and r.log_loss < 0.6 for r in table)
    dated = sample.withColumn("tourney_date", F.make_date("season", F.lit(1), F.lit(1)))
    read = models.read_out(dated, models.drawn(4, space=experiments.SMALL_SPACE), FEATURES, folds=2).collect()
    assert len(read) == 8 and all(r.n == 466 and r.auc > 0.7 for r in read)


def test_other_settings_go_to_spark_ml():
    assert forests.takes(models.forest()) and all(forests.takes(c) for c in models.drawn(50, space=experiments.SMALL_SPACE).values())
    assert not forests.takes(models.boosting()) and not forests.takes(models.logistic()) and not forests.takes(models.forest(depth=20)) and not forests.takes(RandomForestClassifier(labelCol="y", maxBins=64))


def test_nulls_are_an_error(sample):
    fits = [forests.Fit("a", 1993, ["x1"], models.forest(1, 1))]
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="null or NaN in feature x1"):
            forests.grown(sample.withColumn("x1", F.when(F.col("match_num") != 9, F.col("x1")).otherwise(bad)), "season", fits)


def test_metrics_of_groups(spark):
    rnd = random.Random(3)
    rows = [("ab"[i % 2], round(rnd.random(), 2), int(rnd.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, p double, y int")
    got = {r.pop("k"): r for r in models.metrics_by(df, "k")}
    for k in "ab":
        one = models.metrics_of(df.where(F.col("k") == k))
        assert all(math.isclose(got[k][m], one[m], rel_tol=1e-12) for m in one)
    assert models.metrics_of(df.limit(0))["n"] == 0
    both = evaluation.match_evaluation(df.withColumn("match_num", F.lit(1)), by=["k"])
    assert both.count() == 2
