"""Training and comparison of classifiers on the two-perspective sample, with Spark ML; forests of many fits share their passes (forests.py)."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from boutlog.functions.columns import SHARES
from boutlog.operators import evaluation, reshape
from boutlog.plans import forests
from boutlog.session import discard, stored

_BOTH = lambda *names: tuple(f"p{i}_{n}" for n in names for i in (1, 2))
#: The baseline's features, and the smaller set of its first version.
FEATURES = ("surface_code", "level_code", "best_of", "round_code", *_BOTH("rank_log", "points_log", "age", "ht", "is_lefty"), "p1_h2h", *_BOTH("form", "surface_form", *[f"avg_{s}" for s in SHARES]), "rank_log_diff", "points_log_diff", "age_diff", "ht_diff", "form_diff")
FEATURES_17 = ("surface_code", "level_code", *_BOTH("rank_log", "age", "ht"), "p1_h2h", *_BOTH("form", "surface_form"), "rank_log_diff", "age_diff", "ht_diff", "form_diff")
CATEGORICAL = ("surface_code", "level_code", "round_code")


def forest(trees: int = 20, depth: int = 6, seed: int = 42, **more: object) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, **more)


def boosting(rounds: int = 10, depth: int = 4, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="_x", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed)


def logistic() -> LogisticRegression:
    return LogisticRegression(featuresCol="_scaled", labelCol="y", maxIter=50)


def fit(train: DataFrame, classifier, features: Sequence[str] | None = FEATURES, categorical: Sequence[str] = (), categories: int = 32) -> PipelineModel:
    """The fitted pipeline; ``categorical`` features (with up to ``categories`` values) are split as sets by trees, without an order of their codes.

    Values of a categorical feature that were not seen in training go together as one more category. Without ``features`` train has
    its vectors (see assembled).
    """
    if features is None:
        scaled = [StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True)] if classifier.getFeaturesCol() == "_scaled" else []
        return Pipeline(stages=[*scaled, classifier]).fit(train)
    plain = [f for f in features if f not in categorical]
    steps = []
    if categorical:
        steps = [VectorAssembler(inputCols=list(categorical), outputCol="_codes", handleInvalid="error"), VectorIndexer(inputCol="_codes", outputCol="_sets", maxCategories=categories, handleInvalid="keep")]
    steps.append(VectorAssembler(inputCols=[*plain, *(["_sets"] if categorical else [])], outputCol="_x", handleInvalid="error"))
    if classifier.getFeaturesCol() == "_scaled":
        steps.append(StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True))
    return Pipeline(stages=[*steps, classifier]).fit(train)


def assembled(sample: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The sample stored with its features as the vector _x, in place of their columns: fits on it (features: None) and predictions don't assemble them on every pass."""
    keep = [c for c in ("match_num", "season", "fold", "y") if c in sample.columns]
    return stored(VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(sample).select(*keep, "_x"))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("_x", "_codes", "_sets", "_scaled", "rawPrediction", "probability", "prediction")


def sigmoid(validation: DataFrame, score: str = "p") -> PipelineModel:
    """A logistic curve of the score, fitted to smoothed targets: (n1 + 1) / (n1 + 2) for label 1, 1 / (n0 + 2) for label 0.

    A row with target t is a row of label 1 with weight t and one of label 0 with weight 1 - t; the likelihood is the same.
    """
    n = validation.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).first()
    target = F.when(F.col("y") == 1, F.lit((n["n1"] + 1) / (n["n1"] + 2))).otherwise(F.lit(1 / (n["n0"] + 2)))
    row = lambda y, w: F.struct(F.lit(y).alias("y"), w.alias("weight"))
    twins = validation.select(score, target.alias("_t")).select(score, F.inline(F.array(row(1.0, F.col("_t")), row(0.0, 1 - F.col("_t")))))
    curve = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="weight", maxIter=200, tol=1e-12, regParam=0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_x"), curve]).fit(twins)


def platt(model: PipelineModel, validation: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with p calibrated: sigmoid() of the frozen model's probability, fitted on validation rows, which are scored once."""
    scores = lambda df: predict(model, df).withColumnRenamed("p", "_z")
    known = stored(scores(validation).select("y", "_z"))
    curve = sigmoid(known, "_z")
    discard(known)
    return predict(curve, scores(rows)).drop("_z")


def folded(sample: DataFrame, folds: int = 5) -> DataFrame:
    """sample with fold (see reshape.expanding_folds) of its matches: both views of a match stay together."""
    places = reshape.expanding_folds(sample.select("match_num", "tourney_date").distinct(), folds).select("match_num", "fold")
    return sample.join(places, "match_num")


def expanding_folds(sample: DataFrame, folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """(earlier, next) parts of each fold of a sample, which may have its folds already."""
    tagged = sample if "fold" in sample.columns else folded(sample, folds)
    return [(tagged.where(F.col("fold") < k), tagged.where(F.col("fold") == k)) for k in range(1, folds + 1)]


def importance(spark, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """feature, importance, rank of a forest or boosting model: one row per feature."""
    return ranked(spark, model.stages[-1].featureImportances.toArray().tolist(), features)


def ranked(spark, values: Sequence[float], features: Sequence[str] = FEATURES) -> DataFrame:
    """The same of values at hand."""
    order = sorted(zip(features, values), key=lambda z: (-z[1], z[0]))
    return spark.createDataFrame([(f, float(v), i) for i, (f, v) in enumerate(order, 1)], "feature string, importance double, rank int")


def mean_rank(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("feature").agg(F.avg("rank").alias("mean_rank"), F.avg("importance").alias("mean_importance"))


#: Rows that fits at one time may hold together: a tree's fit keeps each row's bins, at some 350 bytes for 40 features and 20 trees.
ROWS_AT_ONCE = 32_000_000


def fits_at_once(sample: DataFrame, most: int = 8) -> int:
    """How many fits run at a time: ``most`` while they are too small to keep a cluster busy, fewer where their rows would not stay in memory."""
    return max(1, min(most, ROWS_AT_ONCE // max(1, sample.count())))


def seed_sweep(spark, train: DataFrame, test: DataFrame, seeds: Sequence[int], features: Sequence[str] = FEATURES) -> DataFrame:
    """seed, accuracy (match level), brier, log_loss of each seed; the forests of all seeds share their passes."""
    keep = ["match_num", F.col("y"), *features]
    rows = train.select(F.lit(0).alias("_part"), *keep).unionByName(test.select(F.lit(1).alias("_part"), *keep))
    made = forests.grown(rows, "_part", [forests.Fit(str(seed), 1, features, forest(seed=seed)) for seed in seeds])
    scored = stored(made.scored())
    made.close()
    matches = {r["name"]: r["accuracy"] for r in evaluation.match_evaluation(scored, by=["name"]).groupBy("name").agg(F.avg("correct").alias("accuracy")).collect()}
    found = [(int(r["name"]), matches[r["name"]], r["brier"], r["log_loss"]) for r in evaluation.losses(scored, "name").collect()]
    discard(scored)
    return spark.createDataFrame(sorted(found), "seed int, accuracy double, brier double, log_loss double")


def compare(train: DataFrame, test: DataFrame, base: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Paired outcomes of one forest with two feature sets: the ablation step of every walk-forward experiment."""
    one, two = (evaluation.match_evaluation(predict(fit(train, forest(), f), test)) for f in (base, other))
    seasons = test.select("match_num", "season").distinct()
    return evaluation.paired(one.join(seasons, "match_num"), two)


# --- walk-forward: every season is predicted by models fitted on the seasons before it


def season_folds(sample: DataFrame, seasons: Sequence[int]) -> list[tuple[int, DataFrame, DataFrame]]:
    """(season, rows of earlier seasons, the season's rows)."""
    return [(s, sample.where(F.col("season") < s), sample.where(F.col("season") == s)) for s in seasons]


@dataclass(frozen=True)
class Variant:
    """A feature set with a classifier; ``categorical`` features are split as sets."""

    features: Sequence[str]
    classifier: object
    categorical: Sequence[str] = ()


def walk_forward(sample: DataFrame, seasons: Sequence[int], variants: dict[str, Variant], at_once: int | None = None) -> DataFrame:
    """match_num, season, variant, prob, correct. Seasons without earlier rows are left out.

    The forests of all seasons and variants share their passes; other fits run ``at_once`` (by default fits_at_once) at a time. What is
    returned reads rows that ended() removes.
    """
    shared = [n for n, v in variants.items() if forests.takes(v.classifier) and not v.categorical]
    alone = {n: v for n, v in variants.items() if n not in shared}
    parts, made = [], []

    def run(job: tuple) -> DataFrame:
        (s, train, test), (name, v) = job
        scored = predict(fit(train, v.classifier, v.features, v.categorical), test)
        return evaluation.match_evaluation(scored).select("match_num", F.lit(s).cast("long").alias("season"), F.lit(name).alias("variant"), "prob", "correct")

    if shared:
        made.append(forests.grown(sample, "season", [forests.Fit(n, s, variants[n].features, variants[n].classifier) for s in seasons for n in shared]))
        scored = made[0].scored().withColumnsRenamed({"part": "season", "name": "variant"})
        parts.append(evaluation.match_evaluation(scored, by=["season", "variant"]).select("match_num", "season", "variant", "prob", "correct"))
    if alone:
        with ThreadPoolExecutor(at_once or fits_at_once(sample)) as pool:
            parts += pool.map(run, itertools.product(season_folds(sample, seasons), alone.items()))
    out = reduce(DataFrame.unionByName, parts)
    out._made = made
    return out


def ended(walked: DataFrame) -> DataFrame:
    """walk_forward's rows stored, and what they were made from removed."""
    out = stored(walked)
    for g in walked._made:
        g.close()
    return out


def outcomes(walked: DataFrame, base: str, other: str) -> DataFrame:
    """match_num, season, a (base right), b (other right) of two variants of walk_forward."""
    of = lambda v: walked.where(F.col("variant") == v)
    return evaluation.paired(of(base), of(other))


def metrics_of(scored: DataFrame) -> dict:
    """n, accuracy, brier, log_loss and auc of scored rows, all from one pass: the rows of each label per distinct p, which are kept until the end."""
    found = metrics_by(scored)
    return found[0] if found else {"n": 0, "accuracy": None, "brier": None, "log_loss": None, "auc": None}


def metrics_by(scored: DataFrame, *by: str) -> list[dict]:
    """The same of every group of rows that has any."""
    counts = scored.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).persist()
    p, a, b = F.col("p"), F.col("a"), F.col("b")
    n, q = F.sum(a + b), evaluation.clipped(p)
    some = counts.groupBy(*by).agg(n.alias("n"), (F.sum(F.when(p > 0.5, a).otherwise(b)) / n).alias("accuracy"), (F.sum(a * F.pow(p - 1, 2) + b * F.pow(p, 2)) / n).alias("brier"), (-F.sum(a * F.ln(q) + b * F.ln(1 - q)) / n).alias("log_loss"))
    key = lambda r: tuple(r[k] for k in by)
    areas = {key(r): r["auc"] for r in evaluation.auc_of(counts, *by).collect()}
    out = [{**r.asDict(), "auc": areas[key(r)]} for r in some.collect() if r["n"]]
    counts.unpersist()
    return out


def read_out(sample: DataFrame, classifiers: dict[str, object], features: Sequence[str] = FEATURES, folds: int = 5, at_once: int | None = None) -> DataFrame:
    """setting, fold, n, accuracy, brier, log_loss, auc of every classifier over expanding folds; a row per classifier and fold.

    The sample is tagged with its folds and stored once. Forests share their passes over it; for other classifiers its features are
    stored as vectors, and fits run ``at_once`` at a time, as each is too small to keep a cluster busy. Rows come in the order of settings
    and folds, whichever fit ends first.
    """
    shared = {n: c for n, c in classifiers.items() if forests.takes(c)}
    kept = stored(folded(sample, folds).select("match_num", "fold", "y", *features))
    found = {}
    if shared:
        made = forests.grown(kept, "fold", [forests.Fit(n, k, features, c) for n, c in shared.items() for k in range(1, folds + 1)])
        scored = stored(made.scored())
        made.close()
        found = {(r["name"], r["part"]): r for r in metrics_by(scored, "name", "part")}
        discard(scored)
    if len(shared) < len(classifiers):
        tagged = assembled(kept, features)
        parts = expanding_folds(tagged, folds)

        def run(job: tuple[str, int]) -> dict:
            name, k = job
            earlier, later = parts[k - 1]
            return metrics_of(predict(fit(earlier, classifiers[name], None), later))

        jobs = [(name, k) for name in classifiers if name not in shared for k in range(1, folds + 1)]
        with ThreadPoolExecutor(at_once or fits_at_once(tagged)) as pool:
            found |= dict(zip(jobs, pool.map(run, jobs)))
        discard(tagged)
    discard(kept)
    none = dict.fromkeys(("accuracy", "brier", "log_loss", "auc"))
    rows = [(name, k, *[found.get((name, k), {"n": 0, **none})[m] for m in ("n", "accuracy", "brier", "log_loss", "auc")]) for name in classifiers for k in range(1, folds + 1)]
    return sample.sparkSession.createDataFrame(rows, "setting string, fold int, n long, accuracy double, brier double, log_loss double, auc double")


def chosen(table: DataFrame) -> DataFrame:
    """Mean metrics of each setting of read_out, and the one of the least mean log-loss (then the first by name) marked."""
    means = table.groupBy("setting").agg(*[F.avg(m).alias(m) for m in ("accuracy", "brier", "log_loss", "auc")])
    best = means.agg(F.min(F.struct(F.col("log_loss").isNull().alias("none"), "log_loss", "setting"))["setting"].alias("_best"))
    return means.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("setting") == F.col("_best")).drop("_best")


#: The search space: trees, depth (30 is the deepest there is), rows in a leaf, share of features at a split, share of rows of a tree.
#: A least number of rows to split a node has no counterpart; a node is split where both parts keep their leaf's rows.
SPACE = {"numTrees": (100, 200, 300, 500), "maxDepth": (10, 15, 20, 30), "minInstancesPerNode": (1, 2, 4, 8), "featureSubsetStrategy": ("sqrt", "log2"), "bootstrap": (True,), "subsamplingRate": (0.7, 0.8, 0.9, 1.0), "impurity": ("gini",)}


def drawn(n: int = 50, seed: int = 42, space: Mapping[str, Sequence] = SPACE) -> dict[str, RandomForestClassifier]:
    """n different forests with settings drawn from the space (all of it, if it has no more), by name."""
    rnd = random.Random(seed)
    every = list(itertools.product(*space.values()))
    out = {}
    for values in rnd.sample(every, min(n, len(every))):
        settings = dict(zip(space, values))
        out["-".join(map(str, values))] = RandomForestClassifier(featuresCol="_x", labelCol="y", seed=seed, **settings)
    return out


def search(sample: DataFrame, classifiers: dict[str, object], features: Sequence[str] = FEATURES, folds: int = 5, at_once: int | None = None, save_to: str | None = None) -> tuple[DataFrame, str, PipelineModel]:
    """The table of read_out, the name of the chosen classifier, and it fitted again on the whole sample (and saved)."""
    table = read_out(sample, classifiers, features, folds, at_once)
    name = chosen(table).where("chosen").first()["setting"]
    model = fit(sample, classifiers[name], features)
    if save_to:
        model.write().overwrite().save(save_to)
    return table, name, model
