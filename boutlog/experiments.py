"""Experiments as queries: the baseline from log to evaluated model, walk-forward comparisons, searches, seeds, and more steps of market and resolution.

Registers its queries with the registry. Models give results that differ between engines in the last places, so their queries
have no SQL and are tested on small data; the others have DuckDB SQL. A walk-forward predicts every season that has earlier
ones, each from those alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from boutlog import registry
from boutlog.functions.columns import mcnemar_z, two_sided_p, two_sided_p_sql
from boutlog.operators import evaluation, history, odds, recursive, reshape, resolution, venue
from boutlog.plans import forests, models
from boutlog.plans.models import FEATURES, FEATURES_17, Variant
from boutlog.registry import OTHER, PV, SCORED, _NAMES, _ODDS, _PAIRS, _mc, named, pairs_of, register
from boutlog.session import discard, shared_folder, stored

SPEED = ("court_pace", "ace_speed_diff", "first_won_speed_diff")
FATIGUE = tuple(f"{x}{n}{d}" for n in ("rest_days", "tourney_minutes") for x, d in (("p1_", ""), ("p2_", ""), ("", "_diff")))
#: Nested subsets of the enriched features: nine, three, two, one.
NESTED = {"full": (*SPEED, *FATIGUE), "speed3": SPEED, "narrow2": ("first_won_speed_diff", "ace_speed_diff"), "single1": ("first_won_speed_diff",)}
SEEDS = tuple(range(42, 52))
#: The search space at the size of these tables; models.SPACE is the one for a full log.
SMALL_SPACE = {"numTrees": (5, 10, 15), "maxDepth": (3, 5, 7), "minInstancesPerNode": (1, 5, 20), "featureSubsetStrategy": ("sqrt", "log2"), "bootstrap": (True,), "subsamplingRate": (0.7, 0.8, 0.9, 1.0), "impurity": ("gini", "entropy")}


def _seasons(sample: DataFrame) -> list[int]:
    """The seasons that have earlier ones."""
    return sorted(r[0] for r in sample.select("season").distinct().collect())[1:]


def _both(names: Sequence[str]) -> list[str]:
    return [f"p{i}_{n}" for n in names for i in (1, 2)]


def _three(names: Sequence[str]) -> list[str]:
    return [c for n in names for c in (f"p1_{n}", f"p2_{n}", f"{n}_diff")]


def _sample(m: DataFrame) -> DataFrame:
    return stored(reshape.sample(history.baseline(m)))


def enriched_sample(m: DataFrame) -> DataFrame:
    """The baseline sample with speed (from the seasons before) and fatigue features."""
    sample = reshape.sample(history.with_rest(history.baseline(m)), ["rest_days", "tourney_minutes"])
    paced = sample.join(venue.with_pace_before(m).select("match_num", "court_pace"), "match_num")
    return paced.withColumns({f"{n}_speed_diff": (F.col(f"p1_avg_{c}") - F.col(f"p2_avg_{c}")) * F.col("court_pace") for n, c in (("ace", "ace_rate"), ("first_won", "first_won_pct"))})


def variant_sample(m: DataFrame, *variants: str) -> DataFrame:
    """The baseline sample with the features of the variants."""
    flags, names = (list(dict.fromkeys(c for v in variants for c in history.VARIANTS[v][i])) for i in (0, 1))
    return reshape.sample(history.with_variants(history.extended(m)), names, flags)


def variant_features(variant: str) -> list[str]:
    flags, names = history.VARIANTS[variant]
    return [*FEATURES, *flags, *_three(names)]


def ewma_sample(m: DataFrame) -> DataFrame:
    """The baseline sample with exponential averages in place of last-n means, under the same names."""
    view = recursive.with_ewma_serve(recursive.with_ewma_surface_form(recursive.with_ewma_form(history.with_h2h(history.player_view(m)))))
    return reshape.sample(view.withColumnsRenamed({"ewma_form": "form", "ewma_surface_form": "surface_form", **{f"ewma_{s}": f"avg_{s}" for s in registry.SHARES}}))


def _walked(sample: DataFrame, variants: dict[str, Variant]) -> DataFrame:
    """walk_forward over all seasons, stored; the sample is removed."""
    out = models.ended(models.walk_forward(sample, _seasons(sample), variants))
    discard(sample)
    return out


def _report(walked: DataFrame, base: str, other: str) -> DataFrame:
    return evaluation.walk_forward(models.outcomes(walked, base, other)).withColumn("p", two_sided_p(F.col("z")))


def _reports(walked: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """_report of several variants, with the correlation over seasons of the base's accuracy and the gain."""
    out = None
    for other in others:
        pairs = models.outcomes(walked, base, other)
        one = _report(walked, base, other).crossJoin(F.broadcast(evaluation.delta_correlation(pairs))).withColumn("variant", F.lit(other))
        out = one if out is None else out.unionByName(one)
    return out


def baseline_pipeline(m: DataFrame, draws: int = 10, space: dict = SMALL_SPACE) -> DataFrame:
    """From log to evaluated model: features, split in time, search with refit, calibration on the validation part, evaluation on the test part.

    A row for the raw and one for the calibrated probabilities, with the chosen setting and its log-loss over the folds.
    """
    spark = m.sparkSession
    split = reshape.chrono_split(m).select("match_num", "split")
    sample = stored(reshape.sample(history.baseline(m)).join(split, "match_num"))
    train, val, test = (sample.where(F.col("split") == s) for s in ("train", "val", "test"))
    table, name, model = models.search(train, models.drawn(draws, space=space), save_to=f"{shared_folder(spark)}/model-{uuid.uuid4().hex}")
    cv = models.chosen(table).where("chosen").first()
    rows = []
    for kind, scored in (("raw", models.predict(model, test)), ("calibrated", models.platt(model, val, test))):
        scored = stored(scored.select("match_num", "y", "p"))
        found = models.metrics_of(scored)
        match = evaluation.match_evaluation(scored).agg(F.avg("correct")).first()[0]
        rows.append((kind, name, cv["log_loss"], found["n"], found["accuracy"], match, found["brier"], found["log_loss"], evaluation.ece(scored).first()[0], found["auc"]))
        discard(scored)
    discard(sample)
    return spark.createDataFrame(rows, "probabilities string, setting string, cv_log_loss double, n long, accuracy double, match_accuracy double, brier double, log_loss double, ece double, auc double")


def walkforward_enriched(m: DataFrame) -> DataFrame:
    """Baseline features against those with speed and fatigue, season by season."""
    walked = _walked(stored(enriched_sample(m)), {"base": Variant(FEATURES, models.forest()), "enriched": Variant([*FEATURES, *NESTED["full"]], models.forest())})
    return _report(walked, "base", "enriched")


def _with_elo(m: DataFrame) -> tuple[DataFrame, list[str]]:
    sample = reshape.sample(history.baseline(m)).join(recursive.elo_features(recursive.elo(m)).select("match_num", "elo_diff", "elo_prob", "surface_elo_diff", "surface_elo_prob"), "match_num")
    won = F.col("y") == 1
    turned = {n: F.when(won, F.col(n)).otherwise(-F.col(n) if n.endswith("diff") else 1 - F.col(n)) for n in ("elo_diff", "elo_prob", "surface_elo_diff", "surface_elo_prob")}
    return stored(sample.withColumns(turned)), list(turned)


def walkforward_elo(m: DataFrame) -> DataFrame:
    """Baseline features against those with ratings, season by season."""
    sample, names = _with_elo(m)
    return _report(_walked(sample, {"base": Variant(FEATURES, models.forest()), "elo": Variant([*FEATURES, *names], models.forest())}), "base", "elo")


def walkforward_odds(m: DataFrame) -> DataFrame:
    """Baseline features against those with implied probabilities, season by season, with the market's own accuracy beside."""
    priced = odds.with_odds(m)
    sides = odds.two_sided(priced).select("match_num", "y", "p1_price", "price_diff", "has_odds")
    sample = stored(reshape.sample(history.baseline(m)).join(sides.withColumn("p2_price", 1 - F.col("p1_price")), ["match_num", "y"]))
    walked = _walked(sample, {"base": Variant(FEATURES, models.forest()), "odds": Variant([*FEATURES, "p1_price", "p2_price", "price_diff", "has_odds"], models.forest())})
    market = odds.benchmark(priced, "season").select("season", F.col("accuracy").alias("market_accuracy"), "coverage")
    return _report(walked, "base", "odds").join(F.broadcast(market), "season", "left")


def nested_subsets(m: DataFrame) -> DataFrame:
    """Nine, three, two and one of the enriched features against the baseline, per season and pooled."""
    variants = {"base": Variant(FEATURES, models.forest()), **{n: Variant([*FEATURES, *f], models.forest()) for n, f in NESTED.items()}}
    return _reports(_walked(stored(enriched_sample(m)), variants), "base", list(NESTED))


def validate_variants(m: DataFrame) -> DataFrame:
    """The three variants against the baseline, per season and pooled."""
    variants = {"base": Variant(FEATURES, models.forest()), **{v: Variant(variant_features(v), models.forest()) for v in history.VARIANTS}}
    return _reports(_walked(stored(variant_sample(m, *history.VARIANTS)), variants), "base", list(history.VARIANTS))


def ablations(m: DataFrame) -> DataFrame:
    """Exponential averages in place of means, and fatigue, speed and both beside the baseline, per season and pooled."""
    sets = {"base": (), "fatigue": FATIGUE, "speed": SPEED, "enriched": NESTED["full"]}
    walked = _walked(stored(enriched_sample(m)), {n: Variant([*FEATURES, *f], models.forest()) for n, f in sets.items()})
    ewma = _walked(stored(ewma_sample(m)), {"ewma": Variant(FEATURES, models.forest())})
    return _reports(walked.unionByName(ewma), "base", ["ewma", "fatigue", "speed", "enriched"])


def season_comparison(m: DataFrame) -> DataFrame:
    """Forest, boosting with codes as numbers and as categories, and logistic regression, season by season."""
    kinds = {"forest": Variant(FEATURES, models.forest()), "boosting": Variant(FEATURES, models.boosting()), "boosting_categories": Variant(FEATURES, models.boosting(), models.CATEGORICAL), "logistic": Variant(FEATURES, models.logistic())}
    walked = _walked(_sample(m), kinds)
    return walked.groupBy("season", "variant").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(F.pow(1 - F.col("prob"), 2)).alias("brier"))


def slice_compare_models(m: DataFrame) -> DataFrame:
    """Slices of the last season under the baseline and the three variants, each trained on the seasons before."""
    variants = {"baseline": FEATURES, **{v: variant_features(v) for v in history.VARIANTS}}
    sample = stored(variant_sample(m, *history.VARIANTS))
    walked = models.ended(models.walk_forward(sample, _seasons(sample)[-1:], {n: Variant(f, models.forest()) for n, f in variants.items()}))
    discard(sample)
    view = history.with_form(history.player_view(m))
    wide = stored(reshape.both_sides(view, ["hand", "rank", "age", "form"], ["surface", "level", "best_of", "round"]).join(walked.select("match_num").distinct(), "match_num"))
    frame = lambda n: evaluation.slice_frame(wide.join(walked.where(F.col("variant") == n).select("match_num", "prob", "correct"), "match_num"))
    compared = evaluation.compare_slices({n: evaluation.slices(frame(n)) for n in variants}, "baseline")
    doubles = [c for c, t in compared.dtypes if t == "double"]
    return compared.withColumns({c: F.round(c, 4) for c in doubles}).orderBy("degree", F.desc("support"), "slice")


def seed_stability(m: DataFrame) -> DataFrame:
    """Accuracy, Brier and log-loss over ten seeds, of the first version's 17 features and of all 40: mean, spread, range."""
    sample = _sample(m)
    last = _seasons(sample)[-1]
    train, test = sample.where(F.col("season") < last), sample.where(F.col("season") == last)
    parts = [evaluation.summary(models.seed_sweep(m.sparkSession, train, test, SEEDS, f), ["accuracy", "brier", "log_loss"]).withColumn("features", F.lit(len(f))) for f in (FEATURES_17, FEATURES)]
    discard(sample)
    return parts[0].unionByName(parts[1])


def importance_ranks(m: DataFrame) -> DataFrame:
    """Mean rank and importance of each feature over the forests of all seasons."""
    sample = _sample(m)
    made = forests.grown(sample, "season", [forests.Fit(str(s), s, FEATURES, models.forest()) for s in _seasons(sample)])
    discard(sample)
    made.close()
    return models.mean_rank([models.ranked(m.sparkSession, values) for values in made.importances()])


def _early(m: DataFrame) -> DataFrame:
    return stored(reshape.sample(history.baseline(m)).where("season < 1996"))


def forest_search(m: DataFrame) -> DataFrame:
    """Fifty random settings of a forest over five expanding folds: a row per setting and fold, with the setting's means and whether it is chosen."""
    table = models.read_out(_early(m), models.drawn(50, space=SMALL_SPACE))
    means = models.chosen(table).select("setting", F.col("log_loss").alias("mean_log_loss"), F.col("accuracy").alias("mean_accuracy"), "chosen")
    return table.join(means, "setting")


def cv_read_out(m: DataFrame) -> DataFrame:
    """Metrics of each fold."""
    return models.read_out(_early(m), {"forest": models.forest()})


for _query in (baseline_pipeline, walkforward_enriched, walkforward_elo, walkforward_odds, nested_subsets, validate_variants, ablations, season_comparison, slice_compare_models, seed_stability, importance_ranks, forest_search, cv_read_out):
    register(_query.__name__, _query)

# --- evaluation and market

register(
    "mcnemar_p",
    lambda m: evaluation.mcnemar(pairs_of(m), "season").withColumn("p", F.round(two_sided_p(mcnemar_z(F.col("only_base"), F.col("only_other"))), 12)).select("season", "z", "p"),
    f"SELECT season, z, round(round({two_sided_p_sql('zz')}, 12), 6) + 0.0 AS p FROM (SELECT season, round(zz, 6) + 0.0 AS z, zz FROM (SELECT season, CASE WHEN count(*) FILTER (a <> b) > 0 THEN greatest(abs(count(*) FILTER (a = 1 AND b = 0) - count(*) FILTER (a = 0 AND b = 1)) - 1, 0) / sqrt(count(*) FILTER (a <> b)) ELSE 0 END AS zz FROM pr GROUP BY season))",
    SCORED, OTHER, _PAIRS,
)
register(
    "odds_two_sided",
    lambda m: odds.two_sided(odds.with_odds(m)).select("match_num", "y", "p1_price", "price_diff"),
    "SELECT match_num, y, round(p, 6) + 0.0 AS p1_price, round(2 * p - 1, 6) + 0.0 AS price_diff FROM (SELECT match_num, 1 AS y, winner_prob AS p FROM q UNION ALL SELECT match_num, 0, 1 - winner_prob FROM q)",
    _ODDS,
)
register(
    "market_pooled",
    lambda m: odds.pooled(odds.benchmark(odds.with_odds(m).withColumn("winner_prob", F.round("winner_prob", 12)), "season"), ["accuracy", "brier"]),
    f"SELECT round(sum(accuracy * n) / sum(n), 6) + 0.0 AS accuracy, round(sum(brier * n) / sum(n), 6) + 0.0 AS brier, CAST(sum(n) AS BIGINT) AS n FROM (SELECT avg(CAST(round(winner_prob, 12) > 0.5 AS INT)) FILTER (has_odds = 1) AS accuracy, avg((1 - winner_prob) * (1 - winner_prob)) FILTER (has_odds = 1) AS brier, sum(has_odds) AS n FROM q GROUP BY season)",
    _ODDS,
)


def _attached(m: DataFrame) -> DataFrame:
    prices = m.where("match_num % 4 <> 0").select(F.concat_ws("_", "tourney_id", "match_num").alias("match_key"), F.col("odds_avg_w").alias("feed_w"), F.col("odds_avg_l").alias("feed_l"))
    return odds.attach(m, prices.unionByName(prices.where("match_num % 8 = 1"))).select("match_num", "feed_w", "feed_l")


register("odds_attach", _attached, "SELECT match_num, CASE WHEN match_num % 4 <> 0 THEN round(odds_avg_w, 6) + 0.0 END AS feed_w, CASE WHEN match_num % 4 <> 0 THEN round(odds_avg_l, 6) + 0.0 END AS feed_l FROM matches")
register(
    "duplicate_matches",
    lambda m: m.groupBy("tourney_id", "w_sid", "l_sid", "round").agg(F.count("*").alias("n"), F.min("match_num").alias("first")).where("n > 1"),
    "SELECT tourney_id, w_sid, l_sid, round, count(*) AS n, min(match_num) AS first FROM matches GROUP BY ALL HAVING count(*) > 1",
)

# --- resolution


def _either_way(m: DataFrame) -> DataFrame:
    """Matches against rows of day pages on which half of the pairs stand the other way round."""
    a = resolution.candidate_days(m, (0, 0)).join(named(m), "match_num").select(F.col("match_num").alias("id"), "day", F.col("w_name").alias("n1"), F.col("l_name").alias("n2"))
    swap = F.col("match_num") % 2 == 0
    b = named(m).where("match_num % 3 <> 0").select(F.col("match_num").alias("other"), F.col("tourney_date").alias("day"), F.when(swap, F.col("l_name")).otherwise(F.col("w_name")).alias("n1"), F.when(swap, F.col("w_name")).otherwise(F.col("l_name")).alias("n2"))
    return resolution.unique_either_way(a, b)


register("unique_either_way", _either_way)
register(
    "candidate_days",
    lambda m: resolution.candidate_days(m),
    "SELECT match_num, tourney_date + CAST(i AS INT) AS day FROM matches, range(4) r(i)",
)


register(
    "search_days",
    lambda m: resolution.search_days(m.withColumn("td_date", F.when(F.col("match_num") % 3 != 0, F.date_add("tourney_date", (F.col("match_num") % 9).cast("int"))))),
    """SELECT match_num, tourney_date + CAST(match_num % 9 AS INT) + CAST(i AS INT) AS day, CAST(CASE i WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS INT) AS turn FROM matches, range(-1, 2) r(i) WHERE match_num % 3 <> 0
    UNION ALL SELECT match_num, tourney_date + CAST(i AS INT), CAST(i AS INT) FROM matches, range(15) r(i) WHERE match_num % 3 = 0""",
)


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of day pages made from the match log: the first link's target and both names."""
    m = named(registry.matches_of(spark, sf_dir))
    html = F.concat(F.lit('<table><tr class="head"><th>x</th></tr><tr><td><a href="/m/'), F.col("match_num").cast("string"), F.lit('"><span>'), F.col("w_name"), F.lit("</span> - <span>"), F.col("l_name"), F.lit("</span></a></td></tr></table>"))
    return m.select("match_num", F.explode(resolution.page_rows(html)).alias("r")).select("match_num", "r.*")


registry.QUERIES["page_rows"] = _page_rows
registry.ORACLES["page_rows"] = f"WITH {registry.MATCHES_SQL},{_NAMES}\nSELECT match_num, '/m/' || match_num AS href, wf || ' ' || ws AS team1, lf || ' ' || ls AS team2 FROM nm"


def _price_cells(m: DataFrame) -> DataFrame:
    """Book rows of JSON payloads made from the match log."""
    row = lambda b: F.concat(F.lit(f'<tr data-book="{b}"><td data-odd="'), F.col(f"odds_{b}_w").cast("decimal(10,2)").cast("string"), F.lit('"></td><td data-odd="'), F.col(f"odds_{b}_l").cast("decimal(10,2)").cast("string"), F.lit('"></td></tr>'))
    payload = F.to_json(F.struct(F.concat(F.lit("<table>"), F.coalesce(row("avg"), F.lit("")), F.coalesce(row("b365"), F.lit("")), F.lit("</table>")).alias("odds")))
    return m.select("match_num", F.explode(resolution.price_cells(payload)).alias("z")).select("match_num", "z.book", F.col("z.price1").cast("double").alias("price1"), F.col("z.price2").cast("double").alias("price2"))


register("price_cells", _price_cells, " UNION ALL ".join(f"SELECT match_num, '{b}' AS book, round(odds_{b}_w, 6) + 0.0 AS price1, round(odds_{b}_l, 6) + 0.0 AS price2 FROM matches WHERE odds_{b}_w IS NOT NULL AND odds_{b}_l IS NOT NULL" for b in ("avg", "b365")))
