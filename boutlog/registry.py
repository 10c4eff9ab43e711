"""The library's queries over the derived match log, each with DuckDB SQL that computes the same another way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boutlog.functions.columns import AGE_GAPS, FORM_GAPS, LEVEL_CODES, LEVEL_STRENGTH, RANK_GAPS, ROUND_CODES, SERVE_PRIORS, SERVE_SCORE, SERVE_SCORE_CAP, SHARES, SURFACE_CODES, binned, binned_sql, half_width, share_sql, sorted_pair, tourney_base, without_last_bits
from boutlog.operators import checks, evaluation, history, odds, recursive, reshape, resolution, venue
from boutlog.operators.ordering import shuffled
from boutlog.plans import models
from boutlog.session import prepare, stored
from boutlog.sources.match_log import COLUMNS, MATCHES_SQL, clean, match_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ("match_num", "side")


def matches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: prepare(spark).read.parquet(f"{sf_dir}/{t}.parquet")
    return match_log(read("lineitem"), read("orders"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    names = columns or df.columns
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in names])


def register(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None, *ctes: str, places: Callable[[DataFrame], DataFrame] = rounded) -> None:
    """build takes the match log; sql reads the CTEs before it; places rounds the doubles (rounded or half_up)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return places(build(matches_of(spark, sf_dir)))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = f"WITH {','.join([MATCHES_SQL, *ctes])}\n{sql}"


def half_up(df: DataFrame) -> DataFrame:
    """Doubles to six places, halves up, after the last bits in which engines differ are rounded away: ties fall alike in each."""
    return df.select(*[(F.floor(without_last_bits(F.col(c) * 1_000_000, 4) + 0.5) / 1_000_000).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def half_up_sql(e: str) -> str:
    return f"floor(round(({e}) * 1000000, 4) + 0.5) / 1000000 + 0.0"


def half(*columns: str) -> str:
    return ", ".join(f"{half_up_sql(c)} AS {c.split('.')[-1]}" for c in columns)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def case(x: str, codes: dict, unknown: object) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items()) + f" ELSE {unknown} END"


# --- CTEs of the oracles

_cols = lambda x, y: ", ".join(f"{e} AS {n}" for n, e in history.side_columns(x, y).items())
PV = f"""
pv0 AS (SELECT {_cols('w', 'l')} FROM matches UNION ALL SELECT {_cols('l', 'w')} FROM matches),
pv AS (SELECT *, {", ".join(f"{share_sql(s)} AS {s}" for s in SHARES)}, CASE WHEN svpt > 0 THEN (first_won + second_won) / svpt END AS serve_pts_won,
       row_number() OVER (PARTITION BY player ORDER BY tourney_date, match_num) AS seq, row_number() OVER (PARTITION BY player, surface ORDER BY tourney_date, match_num) AS sseq FROM pv0)"""
_near = "p.tourney_date >= c.tourney_date - INTERVAL 365 DAY"
FORM = f"""
form AS (SELECT c.match_num, c.side, coalesce(avg(p.is_win), 0.5) AS form FROM pv c LEFT JOIN pv p ON p.player = c.player AND p.seq BETWEEN c.seq - 10 AND c.seq - 1 AND {_near} GROUP BY ALL)"""
SURFACE_FORM = f"""
sform AS (SELECT c.match_num, c.side, CASE WHEN count(p.is_win) >= 3 THEN avg(p.is_win) ELSE any_value(f.form) END AS surface_form FROM pv c JOIN form f ON f.match_num = c.match_num AND f.side = c.side
          LEFT JOIN pv p ON p.player = c.player AND p.surface = c.surface AND p.sseq BETWEEN c.sseq - 10 AND c.sseq - 1 AND {_near} GROUP BY c.match_num, c.side)"""
SERVE = f"""
serve AS (SELECT c.match_num, c.side, {", ".join(f"coalesce(avg(p.{s}), {v}) AS avg_{s}" for s, v in SERVE_PRIORS.items())} FROM pv c LEFT JOIN pv p ON p.player = c.player AND p.seq BETWEEN c.seq - 10 AND c.seq - 1 AND {_near} GROUP BY c.match_num, c.side)"""
H2H = """
h2h AS (SELECT c.match_num, c.side, coalesce(sum(p.is_win * 2 - 1), 0) AS h2h FROM pv c LEFT JOIN pv p ON p.player = c.player AND p.opponent = c.opponent AND p.seq < c.seq GROUP BY c.match_num, c.side)"""
BASE = (PV, FORM, SURFACE_FORM)


def _score(prefix: str, substitute: bool) -> str:
    terms = []
    for s, (w, unit) in SERVE_SCORE.items():
        x = f"coalesce({prefix}{s}, {SERVE_PRIORS[s]})" if substitute else prefix + s
        terms.append(f"{w}::DOUBLE * " + (f"least({x} / {unit}::DOUBLE, {SERVE_SCORE_CAP}::DOUBLE)" if unit else x))
    return " + ".join(terms)


def context(name: str, c: history.Context, aggregates: str) -> str:
    """A CTE: aggregates over p, the last n earlier matches that meet the context."""
    keys = "".join(f" AND p.{k} = c.{k}" for k in c.keys)
    return f"""
{name} AS (SELECT match_num, side, {aggregates} FROM (SELECT c.match_num, c.side, p.is_win, p.minutes, {_score('p.', True)} AS ss, coalesce(p.return_pts_won, {SERVE_PRIORS['return_pts_won']}) AS rr,
           row_number() OVER (PARTITION BY c.match_num, c.side ORDER BY p.seq DESC) AS back FROM pv c JOIN (SELECT * FROM pv WHERE {c.condition}) p ON p.player = c.player AND p.seq < c.seq{keys}) WHERE back <= {c.n} GROUP BY match_num, side)"""


def join(*names: str) -> str:
    return "pv c " + " ".join(f"LEFT JOIN {n} ON {n}.match_num = c.match_num AND {n}.side = c.side" for n in names)


# --- base

register("match_log", lambda m: m, f"SELECT {', '.join(f'round({c}, 6) + 0.0 AS {c}' if c.split('_')[-1] in ('age', 'w', 'l') and c != 'match_num' else c for c in COLUMNS)} FROM matches")
register("clean_matches", lambda m: clean(m, ["minutes", "w_rank", "l_rank", "w_hand", "l_hand"]).select("match_num", "season", "surface", "minutes"), f"SELECT match_num, season, surface, {r6('minutes')} FROM matches WHERE minutes IS NOT NULL")
register("drop_report", lambda m: m.groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("minutes").isNull()).alias("dropped"), F.avg(F.col("minutes").isNull().cast("int")).alias("rate")), "SELECT season, count(*) AS n, count(*) FILTER (minutes IS NULL) AS dropped, round(avg(CAST(minutes IS NULL AS INT)), 6) + 0.0 AS rate FROM matches GROUP BY season")
register("encode_categories", lambda m: reshape.encode(m).select("match_num", "surface_code", "level_code", "round_code"), f"SELECT match_num, {case('surface', SURFACE_CODES, -1)} AS surface_code, {case('level', LEVEL_CODES, -1)} AS level_code, {case('round', ROUND_CODES, 3)} AS round_code FROM matches")
register(
    "unknown_category_audit",
    lambda m: reshape.unknown_categories(m.withColumn("surface", F.when(F.col("match_num") % 11 == 0, "Sand").otherwise(F.col("surface"))).withColumn("round", F.when(F.col("match_num") % 17 == 0, "Q1").otherwise(F.col("round")))),
    "SELECT 'surface' AS column_name, 'Sand' AS value, count(*) AS n FROM matches WHERE match_num % 11 = 0 UNION ALL SELECT 'round', 'Q1', count(*) FROM matches WHERE match_num % 17 = 0",
)
register("fitted_encoding", lambda m: reshape.fitted_codes(m.where("season < 1997"), "tourney_id"), "SELECT tourney_id AS value, row_number() OVER (ORDER BY tourney_id) - 1 AS code FROM (SELECT DISTINCT tourney_id FROM matches WHERE season < 1997)")
register(
    "applied_encoding",
    lambda m: reshape.apply_codes(m, reshape.fitted_codes(m.where("season < 1997"), "tourney_id"), "tourney_id", "tourney_code").select("match_num", "tourney_code"),
    "SELECT match_num, coalesce(code, 0) AS tourney_code FROM matches LEFT JOIN (SELECT tourney_id, row_number() OVER (ORDER BY tourney_id) - 1 AS code FROM (SELECT DISTINCT tourney_id FROM matches WHERE season < 1997)) USING (tourney_id)",
)
register(
    "static_features",
    lambda m: reshape.static_features(m).select("match_num", *[f"{x}_{c}" for x in "wl" for c in ("rank_log", "points_log", "is_lefty")], "round_code"),
    "SELECT match_num, " + ", ".join(f"round(ln({x}_rank), 6) + 0.0 AS {x}_rank_log, round(ln({x}_points), 6) + 0.0 AS {x}_points_log, CAST({x}_hand = 'L' AS INT) AS {x}_is_lefty" for x in "wl") + f", {case('round', ROUND_CODES, 3)} AS round_code FROM matches",
)
register(
    "chrono_split",
    lambda m: reshape.chrono_split(m).select("match_num", "split", "match_id"),
    """SELECT match_num, split, row_number() OVER (PARTITION BY split ORDER BY i) - 1 AS match_id FROM (SELECT match_num, i, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT match_num, row_number() OVER (ORDER BY tourney_date, match_num) - 1 AS i, count(*) OVER () AS n FROM matches))""",
)
register(
    "expanding_folds",
    lambda m: reshape.expanding_folds(m).select("match_num", "fold"),
    "SELECT match_num, CAST(CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INT) AS fold FROM (SELECT match_num, row_number() OVER (ORDER BY tourney_date, match_num) - 1 AS i, count(*) OVER () AS n FROM matches)",
)
_views = "(SELECT match_num, unnest([1, 0]) AS y FROM matches)"
register(
    "seeded_shuffle",
    lambda m: shuffled(m.select("match_num", F.explode(F.array(F.lit(1), F.lit(0))).alias("y")), ["match_num", "y"]),
    f"SELECT match_num, y, row_number() OVER (ORDER BY md5('42:' || match_num || ':' || y), match_num, y) - 1 AS place FROM {_views}",
)
register("season_split", lambda m: reshape.season_split(m, 1996, 1997).groupBy("split").agg(F.count("*").alias("n")), "SELECT CASE WHEN season < 1996 THEN 'train' WHEN season = 1996 THEN 'val' WHEN season = 1997 THEN 'test' END AS split, count(*) AS n FROM matches GROUP BY 1")
register(
    "gap_buckets",
    lambda m: m.select("match_num", binned(F.abs(F.col("w_rank") - F.col("l_rank")), RANK_GAPS).alias("rank_gap"), binned(F.abs(F.col("w_age") - F.col("l_age")), AGE_GAPS).alias("age_gap")),
    f"SELECT match_num, {binned_sql('abs(w_rank - l_rank)', RANK_GAPS)} AS rank_gap, {binned_sql('abs(w_age - l_age)', AGE_GAPS)} AS age_gap FROM matches",
)
register("hand_matchup", lambda m: m.select("match_num", sorted_pair(F.col("w_hand"), F.col("l_hand")).alias("hands")), "SELECT match_num, least(w_hand, l_hand) || '-vs-' || greatest(w_hand, l_hand) AS hands FROM matches")
register("tourney_base", lambda m: m.groupBy(tourney_base(F.col("tourney_id")).alias("base")).agg(F.count("*").alias("n"), F.count_distinct("tourney_id").alias("editions")), "SELECT substr(tourney_id, 6) AS base, count(*) AS n, count(DISTINCT tourney_id) AS editions FROM matches GROUP BY 1")
register(
    "context_flags",
    lambda m: reshape.lefty_flags(m).select("match_num", "one_lefty", "is_bo5", "is_qf", "pressure"),
    f"SELECT match_num, CAST((w_hand = 'L') <> (l_hand = 'L') AS INT) AS one_lefty, CAST(best_of = 5 AS INT) AS is_bo5, CAST(round = 'QF' AS INT) AS is_qf, round({case('level', LEVEL_STRENGTH, 0.6)} * CAST(best_of = 5 AS INT), 6)::DOUBLE + 0.0 AS pressure FROM matches",
)

_bad_id = "CASE WHEN match_num % 50 = 0 THEN replace(tourney_id, '-', '') WHEN match_num % 51 <> 0 THEN tourney_id END"
register(
    "id_format_report",
    lambda m: checks.violations(m.withColumn("tourney_id", F.when(F.col("match_num") % 50 == 0, F.replace("tourney_id", F.lit("-"), F.lit(""))).when(F.col("match_num") % 51 != 0, F.col("tourney_id"))), checks.format_check("tourney_id")),
    f"SELECT x AS value, count(*) AS n FROM (SELECT {_bad_id} AS x FROM matches) WHERE NOT regexp_matches(x, '^[0-9]{{4}}-.+') GROUP BY x ORDER BY x LIMIT 5",
)
register("checked_log", lambda m: checks.checked(m, [checks.format_check("tourney_id"), checks.Check("price above one", F.col("odds_avg_w") <= 1, F.col("match_num"))]).groupBy("season").agg(F.count("*").alias("n")), "SELECT season, count(*) AS n FROM matches GROUP BY season")

# --- last-n windows

register("form_last10_365d", lambda m: history.with_form(history.player_view(m)).select(*KEY, "form"), f"SELECT match_num, side, {r6('form')} FROM form", PV, FORM)
register("surface_form", lambda m: history.with_surface_form(history.with_form(history.player_view(m))).select(*KEY, "surface_form"), f"SELECT match_num, side, {r6('surface_form')} FROM sform", *BASE)
register("serve_stats", lambda m: history.with_serve(history.player_view(m)).select(*KEY, *[f"avg_{s}" for s in SHARES]), f"SELECT match_num, side, {r6(*[f'avg_{s}' for s in SHARES])} FROM serve", PV, SERVE)
register("h2h_balance", lambda m: history.with_h2h(history.player_view(m)).select(*KEY, "h2h"), f"SELECT match_num, side, {r6('h2h')} FROM h2h", PV, H2H)
WINDOWS = (3, 5, 10, 15, 20, 30)


def _forms(m: DataFrame) -> DataFrame:
    view = history.player_view(m)
    for n in WINDOWS:
        view = history.with_form(view, n, recent=False, name=f"form_{n}")
    return view.select(*KEY, *[f"form_{n}" for n in WINDOWS])


register("form_by_window", _forms, "SELECT c.match_num, c.side, " + ", ".join(f"round(coalesce(avg(p.is_win) FILTER (p.seq >= c.seq - {n}), 0.5), 6) + 0.0 AS form_{n}" for n in WINDOWS) + " FROM pv c LEFT JOIN pv p ON p.player = c.player AND p.seq BETWEEN c.seq - 30 AND c.seq - 1 GROUP BY c.match_num, c.side", PV)

# --- state in a tournament

register(
    "rest_days",
    lambda m: history.with_rest(history.player_view(m)).select(*KEY, "rest_days"),
    "SELECT c.match_num, c.side, CASE WHEN p.player IS NULL THEN 60.0 ELSE least(greatest(date_diff('day', p.tourney_date, c.tourney_date), 0), 60) END::DOUBLE AS rest_days FROM pv c LEFT JOIN pv p ON p.player = c.player AND p.seq = c.seq - 1",
    PV,
)
_same = "FROM pv c LEFT JOIN pv p ON p.player = c.player AND p.tourney_id = c.tourney_id AND p.seq < c.seq GROUP BY c.match_num, c.side"
register("tourney_minutes", lambda m: history.with_rest(history.player_view(m)).select(*KEY, "tourney_minutes"), f"SELECT c.match_num, c.side, round(coalesce(sum(p.minutes), 0), 6) + 0.0 AS tourney_minutes {_same}", PV)
register("tourney_path", lambda m: history.with_path(history.player_view(m)).select(*KEY, "path_strength", "path_matches"), f"SELECT c.match_num, c.side, round(coalesce(avg(CASE WHEN p.player IS NOT NULL THEN ln(1 + greatest(p.opp_points, 1)) END), 0), 6) + 0.0 AS path_strength, count(p.player)::DOUBLE AS path_matches {_same}", PV)

# --- contexts


def _form_ctes(name: str) -> list[str]:
    c, least, fallback = history.FORMS[name]
    inner = _form_ctes(fallback) if fallback in history.FORMS else []
    own = context(f"x_{name}", c, "count(*) AS n, avg(is_win) AS v")
    source = {"form": "form", "surface_form": "sform"}.get(fallback, fallback)
    value = f"{name} AS (SELECT c.match_num, c.side, CASE WHEN coalesce(x_{name}.n, 0) >= {least} THEN x_{name}.v ELSE {source}.{fallback} END AS {name} FROM {join(f'x_{name}', source)})"
    return [*inner, own, value]


def _with_form(name: str) -> Callable[[DataFrame], DataFrame]:
    def build(m: DataFrame) -> DataFrame:
        view = history.with_surface_form(history.with_form(history.player_view(m)))
        fallback = history.FORMS[name][2]
        if fallback in history.FORMS:
            view = history.with_context_form(view, fallback)
        return history.with_context_form(view, name).select(*KEY, name)

    return build


for _name in history.FORMS:
    register(_name, _with_form(_name), f"SELECT match_num, side, {r6(_name)} FROM {_name}", *BASE, *_form_ctes(_name))


def _experience(m: DataFrame) -> DataFrame:
    view = history.player_view(m)
    for name in history.EXPERIENCES:
        view = history.with_experience(view, name)
    return view.select(*KEY, *history.EXPERIENCES)


register(
    "context_experience",
    _experience,
    "SELECT c.match_num, c.side, " + ", ".join(f"round(least(coalesce(x_{n}.n, 0) / {s}::DOUBLE, 1), 6) + 0.0 AS {n}" for n, (_, s) in history.EXPERIENCES.items()) + f" FROM {join(*[f'x_{n}' for n in history.EXPERIENCES])}",
    PV,
    *[context(f"x_{n}", c, "count(*) AS n") for n, (c, _) in history.EXPERIENCES.items()],
)
register("vs_hand_balance", lambda m: history.with_hand_balance(history.player_view(m)).select(*KEY, "vs_hand_balance"), f"SELECT c.match_num, c.side, round(CASE WHEN x.n >= 3 THEN x.v ELSE 0 END, 6) + 0.0 AS vs_hand_balance FROM {join('x')}", PV, context("x", history.Context("true", ("opp_hand",), 20), "count(*) AS n, avg(is_win * 2 - 1) AS v"))
register(
    "context_avg_minutes",
    lambda m: history.with_minutes(history.player_view(m)).select(*KEY, "avg_minutes", "best_of5_avg_minutes"),
    f"SELECT c.match_num, c.side, round(CASE WHEN x.n >= 3 THEN x.v ELSE 110 END, 6) + 0.0 AS avg_minutes, round(CASE WHEN y.n >= 2 THEN y.v WHEN x.n >= 3 THEN x.v ELSE 110 END, 6) + 0.0 AS best_of5_avg_minutes FROM {join('x', 'y')}",
    PV,
    context("x", history.Context("true", (), 12), "count(minutes) AS n, avg(minutes) AS v"),
    context("y", history.Context("best_of = 5", (), 8), "count(minutes) AS n, avg(minutes) AS v"),
)

# --- serve profiles

register("serve_score", lambda m: history.with_serve(history.player_view(m)).select(*KEY, F.expr(history.serve_score_sql("avg_")).alias("serve_score")), f"SELECT match_num, side, round({_score('avg_', False)}, 6) + 0.0 AS serve_score FROM serve", PV, SERVE)
OWN = f"own AS (SELECT match_num, side, {_score('avg_', False)} AS own_score, avg_return_pts_won AS own_return, 0.5::DOUBLE AS own_stability FROM serve)"


def _profile_ctes(name: str) -> list[str]:
    c, least, fallback = history.PROFILES[name]
    inner = _profile_ctes(fallback) if fallback in history.PROFILES else [OWN]
    own = context(f"x_{name}", c, "count(*) AS n, avg(ss) AS v_score, avg(rr) AS v_return, 1 / (1 + stddev_pop(ss)) AS v_stability")
    value = f"{name} AS (SELECT c.match_num, c.side, " + ", ".join(f"CASE WHEN coalesce(x_{name}.n, 0) >= {least} THEN x_{name}.v_{k} ELSE {fallback}.{fallback}_{k} END AS {name}_{k}" for k in history.PROFILE) + f" FROM {join(f'x_{name}', fallback)})"
    return [*inner, own, value]


def _with_profile(name: str) -> Callable[[DataFrame], DataFrame]:
    def build(m: DataFrame) -> DataFrame:
        wanted = [name] if history.PROFILES[name][2] == "own" else [history.PROFILES[name][2], name]
        return history.with_profiles(history.with_serve(history.player_view(m)), wanted).select(*KEY, *[f"{name}_{k}" for k in history.PROFILE])

    return build


for _name, _query in (("best_of5_serve", "best_of5_serve_profile"), ("surface_serve", "surface_serve_profile"), ("vs_hand_serve", "vs_hand_return")):
    register(_query, _with_profile(_name), f"SELECT match_num, side, {r6(*[f'{_name}_{k}' for k in history.PROFILE])} FROM {_name}", PV, SERVE, *_profile_ctes(_name))
_tops = ["top20_serve", "top30_serve", "top40_serve"]
register(
    "top_opp_serve",
    lambda m: history.with_chosen_profiles(history.with_serve(history.player_view(m))).select(*KEY, *[f"top_opp_serve_{k}" for k in history.PROFILE]),
    "SELECT c.match_num, c.side, " + ", ".join(f"round(CASE WHEN c.level IN ('G', 'M') THEN top20_serve_{k} WHEN c.level IN ('500', 'A', 'F') THEN top30_serve_{k} ELSE top40_serve_{k} END, 6) + 0.0 AS top_opp_serve_{k}" for k in history.PROFILE) + f" FROM {join(*_tops)}",
    PV, SERVE, *dict.fromkeys(x for t in _tops for x in _profile_ctes(t)),
)
register(
    "pressure_serve",
    lambda m: history.with_chosen_profiles(history.with_serve(history.player_view(m))).select(*KEY, *[f"pressure_serve_{k}" for k in history.PROFILE]),
    "SELECT c.match_num, c.side, " + ", ".join(f"round(CASE WHEN c.best_of = 5 THEN best_of5_serve_{k} WHEN c.round IN ('QF', 'SF', 'BR', 'F') THEN late_serve_{k} ELSE own_{k} END, 6) + 0.0 AS pressure_serve_{k}" for k in history.PROFILE) + f" FROM {join('best_of5_serve', 'late_serve', 'own')}",
    PV, SERVE, *dict.fromkeys([*_profile_ctes("best_of5_serve"), *_profile_ctes("late_serve")]),
)


def _endurance(m: DataFrame) -> DataFrame:
    view = history.with_serve(history.with_form(history.player_view(m)))
    view = history.with_minutes(history.with_context_form(history.with_context_form(view, "best_of5_form"), "long_match_form"))
    view = history.with_experience(history.with_experience(view, "best_of5_experience"), "long_match_experience")
    return history.with_endurance(history.with_profiles(view, ["best_of5_serve"])).select(*KEY, "endurance")


_bo5, _long = history.EXPERIENCES["best_of5_experience"], history.EXPERIENCES["long_match_experience"]
register(
    "endurance",
    _endurance,
    f"""SELECT c.match_num, c.side, round(0.25 * best_of5_form.best_of5_form + 0.20 * long_match_form.long_match_form + 0.15 * least(coalesce(e1.n, 0) / 6::DOUBLE, 1) + 0.10 * least(coalesce(e2.n, 0) / 6::DOUBLE, 1)
        + 0.15 * greatest(0, least(1, (CASE WHEN y.n >= 2 THEN y.v WHEN x.n >= 3 THEN x.v ELSE 110 END - 90) / 120)) + 0.15 * best_of5_serve_stability, 6) + 0.0 AS endurance FROM {join('best_of5_form', 'long_match_form', 'e1', 'e2', 'x', 'y', 'best_of5_serve')}""",
    PV, FORM, SERVE, *_form_ctes("best_of5_form"), *_form_ctes("long_match_form"), context("e1", _bo5[0], "count(*) AS n"), context("e2", _long[0], "count(*) AS n"),
    context("x", history.Context("true", (), 12), "count(minutes) AS n, avg(minutes) AS v"), context("y", history.Context("best_of = 5", (), 8), "count(minutes) AS n, avg(minutes) AS v"), *_profile_ctes("best_of5_serve"),
)
_slots = "(CASE WHEN draw_size >= 96 THEN 32 WHEN draw_size >= 56 THEN 16 WHEN draw_size >= 28 THEN 8 ELSE 4 END)::DOUBLE"
register(
    "seed_context",
    lambda m: history.with_seed_context(history.player_view(m)).select(*KEY, "seed_context", "level_strength"),
    f"SELECT match_num, side, round(CASE WHEN seed IS NOT NULL THEN greatest(0, 1 - (seed - 1) / {_slots}) ELSE greatest(0, least(1, ({_slots} + 2 - rank) / ({_slots} + 2))) END, 6) + 0.0 AS seed_context, ({case('level', LEVEL_STRENGTH, 0.6)})::DOUBLE AS level_strength FROM pv",
    PV,
)

# --- venue

_HIST = "hist AS (SELECT *, substr(tourney_id, 6) AS base, w_ace + l_ace AS ace, w_svpt + l_svpt AS svpt FROM matches WHERE w_svpt + l_svpt > 0)"
_PACE = f"""{_HIST}, pt AS (SELECT base, surface, sum(ace) / sum(svpt) AS pace, count(*) AS n FROM hist GROUP BY base, surface HAVING count(*) >= 20), ps AS (SELECT surface, sum(ace) / sum(svpt) AS pace FROM hist GROUP BY surface),
sc AS (SELECT (SELECT sum(ace) / sum(svpt) FROM hist) AS mean, coalesce(nullif(stddev_samp(pace), 0), 0.02) AS std FROM pt),
cp AS (SELECT m.match_num, (coalesce(pt.pace, ps.pace, sc.mean) - sc.mean) / sc.std AS court_pace FROM matches m LEFT JOIN pt ON pt.base = substr(m.tourney_id, 6) AND pt.surface = m.surface LEFT JOIN ps ON ps.surface = m.surface CROSS JOIN sc)"""
register("pace_by_tourney", venue.pace_by_tourney, f"SELECT base, surface, {r6('pace')}, n FROM pt", _PACE)
register("pace_by_surface", venue.pace_by_surface, f"SELECT surface, {r6('pace')} FROM ps", _PACE)
register("court_pace_index", lambda m: venue.with_pace(m, m).select("match_num", "court_pace"), f"SELECT match_num, {r6('court_pace')} FROM cp", _PACE)


def _speed(m: DataFrame) -> DataFrame:
    wide = reshape.both_sides(history.with_serve(history.player_view(m)), ["avg_ace_rate", "avg_first_won_pct"])
    out = reshape.symmetrize(wide, ["avg_ace_rate", "avg_first_won_pct"]).join(venue.with_pace(m, m).select("match_num", "court_pace"), "match_num")
    return out.select("match_num", "y", *[((F.col(f"p1_avg_{c}") - F.col(f"p2_avg_{c}")) * F.col("court_pace")).alias(f"{c}_speed_diff") for c in ("ace_rate", "first_won_pct")])


register(
    "serve_speed_interaction",
    _speed,
    "SELECT a.match_num, CAST(a.side = 'w' AS INT) AS y, " + ", ".join(f"round((a.avg_{c} - b.avg_{c}) * court_pace, 6) + 0.0 AS {c}_speed_diff" for c in ("ace_rate", "first_won_pct")) + " FROM serve a JOIN serve b ON a.match_num = b.match_num AND a.side <> b.side JOIN cp ON cp.match_num = a.match_num",
    PV, SERVE, _PACE,
)

# --- recursive state


def fold(value: str, prior: str, alpha: float, partition: str = "player") -> str:
    kept = f"coalesce(list({value}) FILTER (WHERE {value} IS NOT NULL) OVER (PARTITION BY {partition} ORDER BY tourney_date, match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])"
    return f"list_reduce(list_prepend({prior}::DOUBLE, {kept}), lambda a, x: {alpha}::DOUBLE * x + (1 - {alpha}::DOUBLE) * a)"


def needed(m: DataFrame, *more: str) -> DataFrame:
    """The player view with what averages read, and more."""
    return history.player_view(m).select(*recursive.NEEDED, *more)


_EWMA = f"e AS (SELECT *, {fold('is_win', '0.5', 0.18)} AS ewma_form FROM pv)"
register("ewma_form", lambda m: recursive.with_ewma_form(needed(m)).select(*KEY, "ewma_form"), f"SELECT match_num, side, {half('ewma_form')} FROM e", PV, _EWMA, places=half_up)
register(
    "ewma_surface_form",
    lambda m: recursive.with_ewma_surface_form(recursive.with_ewma_form(needed(m, "surface"))).select(*KEY, "ewma_surface_form"),
    f"SELECT match_num, side, {half_up_sql(fold('is_win', 'first_ewma', 0.18, 'player, surface'))} AS ewma_surface_form FROM s",
    PV, _EWMA, "s AS (SELECT *, first_value(ewma_form) OVER (PARTITION BY player, surface ORDER BY tourney_date, match_num) AS first_ewma FROM e)", places=half_up,
)
register("ewma_serve", lambda m: recursive.with_ewma_serve(needed(m)).select(*KEY, *[F.round(f"ewma_{s}", 12).alias(f"ewma_{s}") for s in SHARES]), "SELECT match_num, side, " + ", ".join(f"round(round({fold(s, str(v), 0.18)}, 12), 6) + 0.0 AS ewma_{s}" for s, v in SERVE_PRIORS.items()) + " FROM pv", PV)
_ten = [("is_win", 0.5), *SERVE_PRIORS.items(), ("serve_pts_won", 0.62)]
register(
    "ewma_momentum",
    lambda m: recursive.with_momentum(needed(m)).select(*KEY, "momentum", "completeness"),
    "SELECT match_num, side, round((" + " + ".join(f"{'-' if s in recursive.LOWER_IS_BETTER else ''}sign(round(a_{s} - b_{s}, 12))" for s, _ in _ten) + ") / 10, 6) + 0.0 AS momentum, " + half_up_sql("a_serve_pts_won * a_return_pts_won") + " AS completeness FROM t",
    PV, "t AS (SELECT match_num, side, " + ", ".join(f"{fold(s, str(v), 0.18)} AS a_{s}, {fold(s, str(v), 0.05)} AS b_{s}" for s, v in _ten) + " FROM pv)", places=half_up,
)
register(
    "serve_advantage",
    lambda m: recursive.serve_advantage(recursive.with_momentum(needed(m))),
    f"SELECT a.match_num, a.side, {half_up_sql('a.s - b.r')} AS serve_advantage FROM t a JOIN t b ON a.match_num = b.match_num AND a.side <> b.side",
    PV, f"t AS (SELECT match_num, side, {fold('serve_pts_won', '0.62', 0.18)} AS s, {fold('return_pts_won', '0.35', 0.18)} AS r FROM pv)", places=half_up,
)
_FIRST_SEEDED = f"e AS (SELECT *, {fold('is_win', '0.5', 0.18)} AS form_short, {fold('is_win', '0.5', 0.05)} AS form_long FROM pv)"
#: The surface state starts at 0.5, but reads as the general form before the surface's first match.
_DUAL = f"d AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY player, surface ORDER BY tourney_date, match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 THEN form_short ELSE {fold('is_win', '0.5', 0.18, 'player, surface')} END AS surface_form FROM e)"
register(
    "dual_horizon_form",
    lambda m: recursive.with_dual_horizon(needed(m, "surface")).select(*KEY, F.col("short_is_win").alias("form_short"), F.col("long_is_win").alias("form_long"), F.col("short_surface_form").alias("surface_form")),
    f"SELECT match_num, side, {half('form_short', 'form_long', 'surface_form')} FROM d",
    PV, _FIRST_SEEDED, _DUAL, places=half_up,
)
_FOLDS = "t AS (SELECT match_num, side, " + ", ".join(f"{fold(s, str(v), 0.18)} AS a_{s}, {fold(s, str(v), 0.05)} AS b_{s}" for s, v in _ten) + " FROM pv)"
_momentum = " + ".join(f"{'-' if s in recursive.LOWER_IS_BETTER else ''}sign(round(a_{s} - b_{s}, 12))" for s, _ in _ten)
_DUAL_SIDES = f"""ds AS (SELECT d.*, ln(d.rank) AS rank_log, ln(d.points) AS points_log, CAST(d.hand = 'L' AS INT) AS is_lefty, h2h.h2h, ({_momentum}) / 10 AS momentum, a_serve_pts_won * a_return_pts_won AS completeness, a_serve_pts_won, {', '.join(f'a_{s}' for s in SHARES)}
          FROM d JOIN t USING (match_num, side) JOIN h2h USING (match_num, side))"""


def _dual_sql() -> str:
    plain = {"ht", "is_lefty"}
    value = lambda x, y, n: f"{x}.a_serve_pts_won - {y}.a_return_pts_won" if n == "serve_advantage" else f"{x}.{'a_' if n in SHARES else ''}{n}"
    whole = lambda e, n: e if n in plain else half_up_sql(e)
    parts = [f"{whole(value(x, y, n), n)} AS p{i}_{n}" for n in recursive.DUAL for i, x, y in ((1, "a", "b"), (2, "b", "a"))]
    parts += [f"{whole(f'a.{n} - b.{n}', n)} AS {n}_diff" for n in ("rank_log", "points_log", "age", "ht", "form_short")]
    codes = f"{case('a.surface', SURFACE_CODES, -1)} AS surface_code, {case('a.level', LEVEL_CODES, -1)} AS level_code, a.best_of, {case('a.round', ROUND_CODES, 3)} AS round_code, a.season, a.tourney_date, round(a.h2h, 6) + 0.0 AS p1_h2h"
    return f"SELECT a.match_num, CAST(a.side = 'w' AS INT) AS y, {codes}, {', '.join(parts)} FROM ds a JOIN ds b ON a.match_num = b.match_num AND a.side <> b.side"


register("dual_horizon_48", recursive.dual_horizon_sample, _dual_sql(), PV, H2H, _FIRST_SEEDED, _DUAL, _FOLDS, _DUAL_SIDES, places=half_up)
register("elo", lambda m: recursive.elo_features(recursive.elo(m)))

# --- reshaping

_s17 = ["rank_log", "points_log", "age", "ht", "is_lefty", "form"]
_SIDES = f"sd AS (SELECT c.*, ln(c.rank) AS rank_log, ln(c.points) AS points_log, CAST(c.hand = 'L' AS INT) AS is_lefty, form.form, sform.surface_form, h2h.h2h, {', '.join(f'serve.avg_{s}' for s in SHARES)} FROM {join('form', 'sform', 'h2h', 'serve')})"


def _sym_sql(names: Sequence[str], diffs: Sequence[str], whole: Sequence[str]) -> str:
    plain = {"player", "ht", "is_lefty"}
    value = lambda x, n: f"{x}.{n}" if n in plain else f"round({x}.{n}, 6) + 0.0"
    parts = [f"{value(x, n)} AS p{i}_{n}" for n in names for i, x in ((1, "a"), (2, "b"))]
    parts += [(f"a.{n} - b.{n}" if n in plain else f"round(a.{n} - b.{n}, 6) + 0.0") + f" AS {n}_diff" for n in diffs]
    return f"SELECT a.match_num, CAST(a.side = 'w' AS INT) AS y, {', '.join([*whole, *parts])} FROM sd a JOIN sd b ON a.match_num = b.match_num AND a.side <> b.side"


_codes = [f"{case('a.surface', SURFACE_CODES, -1)} AS surface_code", f"{case('a.level', LEVEL_CODES, -1)} AS level_code", "a.best_of", f"{case('a.round', ROUND_CODES, 3)} AS round_code", "a.season", "a.tourney_date"]
_shares = [f"avg_{s}" for s in SHARES]
register("symmetrized_40", lambda m: reshape.sample(history.baseline(m)), _sym_sql(["player", *reshape.SMALL, *_shares], ["rank_log", "points_log", "age", "ht", "form"], [*_codes, "round(a.h2h, 6) + 0.0 AS p1_h2h"]), *BASE, SERVE, H2H, _SIDES)


def _small(m: DataFrame) -> DataFrame:
    view = history.with_h2h(history.with_form(history.player_view(m))).withColumns({"rank_log": F.ln("rank"), "points_log": F.ln("points"), "is_lefty": (F.col("hand") == "L").cast("int")})
    wide = reshape.both_sides(view, [*_s17, "h2h"], ["best_of"]).withColumn("h2h", F.col("w_h2h"))
    return reshape.symmetrize(wide, _s17, ["rank_log", "form"], ["h2h"], ["best_of"])


register("symmetrized_17", _small, _sym_sql(_s17, ["rank_log", "form"], ["a.best_of", "round(a.h2h, 6) + 0.0 AS p1_h2h"]), *BASE, SERVE, H2H, _SIDES)
EXTRA = [*history.FORMS, *history.EXPERIENCES, "vs_hand_balance", "avg_minutes", "best_of5_avg_minutes", *[f"{p}_{k}" for p in ("best_of5_serve", "surface_serve", "vs_hand_serve", "top_opp_serve", "pressure_serve") for k in history.PROFILE], "endurance", "seed_context", "path_strength", "path_matches", "rest_days", "tourney_minutes"]
register("variant_features", lambda m: reshape.sample(history.extended(m), EXTRA))

# --- the three variants' features, each with SQL for its own list

_FORM_NAMES = sorted({n for _, names in history.VARIANTS.values() for n in names if n in history.FORMS} | {"long_match_form", "best_of5_form"})
_profile = lambda p, k: f"{p}.{p}_{k}"
_minutes = "CASE WHEN ym.n >= 2 THEN ym.v WHEN xm.n >= 3 THEN xm.v ELSE 110 END"
_exp = {n: f"least(coalesce(x_{n}.n, 0) / {s}::DOUBLE, 1)" for n, (_, s) in history.EXPERIENCES.items()}
#: Feature -> its SQL over c (the player view) and the joined CTEs.
_VARIANT_SQL: dict[str, str] = {
    **{n: f"{n}.{n}" for n in _FORM_NAMES},
    **_exp,
    "vs_hand_balance": "CASE WHEN xb.n >= 3 THEN xb.v ELSE 0 END",
    "best_of5_avg_minutes": _minutes,
    **{f"best_of5_serve_{k}": _profile("best_of5_serve", k) for k in history.PROFILE},
    "bo5_pressure_score": f"CASE WHEN c.best_of = 5 THEN {_profile('best_of5_serve', 'score')} ELSE own.own_score END",
    "endurance": f"0.25 * best_of5_form.best_of5_form + 0.20 * long_match_form.long_match_form + 0.15 * {_exp['best_of5_experience']} + 0.10 * {_exp['long_match_experience']} + 0.15 * greatest(0, least(1, ({_minutes} - 90) / 120)) + 0.15 * {_profile('best_of5_serve', 'stability')}",
    "seed_context": f"CASE WHEN c.seed IS NOT NULL THEN greatest(0, 1 - (c.seed - 1) / {_slots.replace('draw_size', 'c.draw_size')}) ELSE greatest(0, least(1, ({_slots.replace('draw_size', 'c.draw_size')} + 2 - c.rank) / ({_slots.replace('draw_size', 'c.draw_size')} + 2))) END",
    "path_strength": "pa.path_strength",
    "path_matches": "pa.path_matches",
    "surface_serve_score": _profile("surface_serve", "score"),
    "surface_serve_stability": _profile("surface_serve", "stability"),
    "top_opp_serve_score": f"CASE WHEN c.level IN ('G', 'M') THEN {_profile('top20_serve', 'score')} WHEN c.level IN ('500', 'A', 'F') THEN {_profile('top30_serve', 'score')} ELSE {_profile('top40_serve', 'score')} END",
    "vs_hand_serve_return": _profile("vs_hand_serve", "return"),
    "pressure_serve_score": f"CASE WHEN c.best_of = 5 THEN {_profile('best_of5_serve', 'score')} WHEN c.round IN ('QF', 'SF', 'BR', 'F') THEN {_profile('late_serve', 'score')} ELSE own.own_score END",
}
_strength = case("c.level", LEVEL_STRENGTH, 0.6)
_FLAG_SQL = {"is_bo5": "CAST(c.best_of = 5 AS INT)", "is_qf": "CAST(c.round = 'QF' AS INT)", "one_lefty": "CAST((c.hand = 'L') <> (c.opp_hand = 'L') AS INT)", "level_strength": f"{_strength}::DOUBLE", "bo5_pressure": f"({_strength} * CAST(c.best_of = 5 AS INT))::DOUBLE", "qf_pressure": f"({_strength} * CAST(c.round = 'QF' AS INT))::DOUBLE"}
_PATH = f"pa AS (SELECT c.match_num, c.side, coalesce(avg(CASE WHEN p.player IS NOT NULL THEN ln(1 + greatest(p.opp_points, 1)) END), 0) AS path_strength, count(p.player)::DOUBLE AS path_matches {_same})"


def _variant_oracle(flags: Sequence[str], names: Sequence[str]) -> tuple[str, list[str]]:
    """SQL and its CTEs for a variant's flags and features; only the CTEs that they read."""
    text = " ".join(_VARIANT_SQL[n] for n in names)
    reads = lambda x: f"{x}." in text
    ctes = [PV, FORM, SURFACE_FORM, SERVE, OWN]
    joined = []
    for n in _FORM_NAMES:
        if reads(n):
            ctes += _form_ctes(n)
            joined.append(n)
    for n, (c, _) in history.EXPERIENCES.items():
        if reads(f"x_{n}"):
            ctes.append(context(f"x_{n}", c, "count(*) AS n"))
            joined.append(f"x_{n}")
    for p in history.PROFILES:
        if reads(p):
            ctes += _profile_ctes(p)
            joined.append(p)
    more = {"xb": context("xb", history.Context("true", ("opp_hand",), 20), "count(*) AS n, avg(is_win * 2 - 1) AS v"), "xm": context("xm", history.Context("true", (), 12), "count(minutes) AS n, avg(minutes) AS v"), "ym": context("ym", history.Context("best_of = 5", (), 8), "count(minutes) AS n, avg(minutes) AS v"), "pa": _PATH, "own": None}
    for x, cte in more.items():
        if reads(x):
            ctes += [cte] if cte else []
            joined.append(x)
    ctes.append(f"vf AS (SELECT c.match_num, c.side, {', '.join(f'{_FLAG_SQL[f]} AS {f}' for f in flags)}, {', '.join(f'{_VARIANT_SQL[n]} AS {n}' for n in names)} FROM {join(*joined)})")
    parts = [f"{half_up_sql(f'a.{f}')} AS {f}" if "strength" in f or "pressure" in f else f"a.{f}" for f in flags]
    parts += [f"{half_up_sql(e)} AS {a}{n}{d}" for n in names for a, e, d in (("p1_", f"a.{n}", ""), ("p2_", f"b.{n}", ""), ("", f"a.{n} - b.{n}", "_diff"))]
    return f"SELECT a.match_num, CAST(a.side = 'w' AS INT) AS y, {', '.join(parts)} FROM vf a JOIN vf b ON a.match_num = b.match_num AND a.side <> b.side", list(dict.fromkeys(ctes))


def _variant_query(flags: Sequence[str], names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    wanted = [c for n in names for c in (f"p1_{n}", f"p2_{n}", f"{n}_diff")]
    return lambda m: reshape.sample(history.with_variants(history.extended(m)), names, flags).select("match_num", "y", *flags, *wanted)


for _name, (_flags, _names) in history.VARIANTS.items():
    _sql, _ctes = _variant_oracle(_flags, _names)
    register(f"variant_{_name}", _variant_query(_flags, _names), _sql, *_ctes, places=half_up)

# --- market

_ODDS = """o AS (SELECT *, CASE WHEN odds_avg_w IS NOT NULL AND odds_avg_l IS NOT NULL THEN odds_avg_w WHEN odds_b365_w IS NOT NULL AND odds_b365_l IS NOT NULL THEN odds_b365_w END AS odds_w,
 CASE WHEN odds_avg_w IS NOT NULL AND odds_avg_l IS NOT NULL THEN odds_avg_l WHEN odds_b365_w IS NOT NULL AND odds_b365_l IS NOT NULL THEN odds_b365_l END AS odds_l FROM matches),
q AS (SELECT *, CAST(coalesce(odds_w > 1 AND odds_l > 1, false) AS INT) AS has_odds, CASE WHEN odds_w > 1 AND odds_l > 1 THEN (1 / odds_w) / (1 / odds_w + 1 / odds_l) ELSE 0.5 END AS winner_prob FROM o)"""
register("odds_cascade", lambda m: odds.with_odds(m).select("match_num", "odds_w", "odds_l", "has_odds"), f"SELECT match_num, {r6('odds_w', 'odds_l')}, has_odds FROM q", _ODDS)
register("implied_prob", lambda m: odds.with_odds(m).select("match_num", "winner_prob", (1 - F.col("winner_prob")).alias("loser_prob"), (2 * F.col("winner_prob") - 1).alias("diff")), "SELECT match_num, round(winner_prob, 6) + 0.0 AS winner_prob, round(1 - winner_prob, 6) + 0.0 AS loser_prob, round(2 * winner_prob - 1, 6) + 0.0 AS diff FROM q", _ODDS)
_bench = "round(avg(has_odds), 6) + 0.0 AS coverage, round(avg(CAST(round(winner_prob, 12) > 0.5 AS INT)) FILTER (has_odds = 1), 6) + 0.0 AS accuracy, round(avg((1 - winner_prob) * (1 - winner_prob)) FILTER (has_odds = 1), 6) + 0.0 AS brier, sum(has_odds)::BIGINT AS n"
register("market_benchmark", lambda m: odds.benchmark(odds.with_odds(m).withColumn("winner_prob", F.round("winner_prob", 12)), "season"), f"SELECT season, {_bench} FROM q GROUP BY season", _ODDS)
register("overround", lambda m: odds.overround(odds.with_odds(m), "season"), "SELECT season, round(avg(1 / odds_w + 1 / odds_l - 1), 6) + 0.0 AS overround FROM q WHERE has_odds = 1 GROUP BY season", _ODDS)
register("book_averages", lambda m: m.select("match_num", odds.row_mean(["odds_avg_w", "odds_b365_w"]).alias("mean_w"), odds.row_mean(["odds_avg_l", "odds_b365_l"]).alias("mean_l")), "SELECT match_num, " + ", ".join(f"round(list_avg([odds_avg_{x}, odds_b365_{x}]), 6) + 0.0 AS mean_{x}" for x in "wl") + " FROM matches")

# --- evaluation with fixed scores


def fixed_score(m: DataFrame, points: float = 0.3, lead: float = 0.1) -> DataFrame:
    """Two rows per match with p from fixed coefficients of rank and points; ``lead`` makes the perspectives differ."""
    z = lambda a, b: -0.6 * (F.ln(f"{a}_rank") - F.ln(f"{b}_rank")) + points * (F.ln(f"{a}_points") - F.ln(f"{b}_points")) + lead
    row = lambda a, b, y: F.struct(F.lit(y).alias("y"), F.round(1 / (1 + F.exp(-z(a, b))), 12).alias("p"))
    return m.select("match_num", "season", F.inline(F.array(row("w", "l", 1), row("l", "w", 0))))


def _scored_sql(name: str, points: float, lead: float) -> str:
    z = lambda a, b: f"-0.6::DOUBLE * (ln({a}_rank) - ln({b}_rank)) + {points}::DOUBLE * (ln({a}_points) - ln({b}_points)) + {lead}::DOUBLE"
    return f"""{name} AS (SELECT match_num, season, 1 AS y, round(1 / (1 + exp(-({z('w', 'l')}))), 12) AS p FROM matches UNION ALL SELECT match_num, season, 0, round(1 / (1 + exp(-({z('l', 'w')}))), 12) FROM matches),
{name}_ev AS (SELECT match_num, any_value(season) AS season, prob, CAST(prob > 0.5 AS INT) AS correct FROM (SELECT match_num, season, round(avg(CASE WHEN y = 1 THEN p ELSE 1 - p END) OVER (PARTITION BY match_num), 12) AS prob FROM {name}) GROUP BY match_num, prob)"""


SCORED, OTHER = _scored_sql("sc", 0.3, 0.1), _scored_sql("so", 0.0, 0.0)
register("match_eval", lambda m: evaluation.match_evaluation(fixed_score(m)), f"SELECT match_num, {r6('prob')}, correct FROM sc_ev", SCORED)
register("one_sided_eval", lambda m: evaluation.one_sided_evaluation(fixed_score(m)).agg(F.avg("correct").alias("accuracy")), "SELECT round(avg(CAST(p > 0.5 AS INT)), 6) + 0.0 AS accuracy FROM sc WHERE y = 1", SCORED)
register("naive_favourite", lambda m: m.groupBy("season").agg(F.avg((F.col("w_rank") < F.col("l_rank")).cast("int")).alias("accuracy")), "SELECT season, round(avg(CAST(w_rank < l_rank AS INT)), 6) + 0.0 AS accuracy FROM matches GROUP BY season")
register(
    "confusion",
    lambda m: evaluation.confusion(fixed_score(m)),
    """SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1,
    round(((tp + tn) / n - e) / (1 - e), 6) + 0.0 AS kappa FROM (SELECT *, tp + fp + tn + fn AS n, ((tp + fp) / (tp + fp + tn + fn) * (tp + fn) + (fn + tn) / (tp + fp + tn + fn) * (fp + tn)) / (tp + fp + tn + fn) AS e FROM
    (SELECT count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 0) AS tn, count(*) FILTER (p <= 0.5 AND y = 1) AS fn FROM sc))""",
    SCORED,
)
register("auc", lambda m: evaluation.auc(fixed_score(m)), "SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM sc)", SCORED)
_loss = "round(avg((p - y) * (p - y)), 6) + 0.0 AS brier, round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-15, least(p, 1 - 1e-15))) ELSE ln(1 - greatest(1e-15, least(p, 1 - 1e-15))) END), 6) + 0.0 AS log_loss"
register("brier_logloss", lambda m: evaluation.losses(fixed_score(m), "season"), f"SELECT season, {_loss} FROM sc GROUP BY season", SCORED)
_REL = """bins AS (SELECT CAST(i AS INT) AS bin FROM range(10) t(i)), rel AS (SELECT bin, count(p) AS n, avg(p) AS predicted, avg(CASE WHEN p IS NOT NULL THEN y END) AS observed FROM bins LEFT JOIN sc ON p >= bin * 0.1::DOUBLE AND (p < (bin + 1) * 0.1::DOUBLE OR bin = 9) GROUP BY bin)"""
register("reliability", lambda m: evaluation.reliability(fixed_score(m)), "SELECT bin, bin / 10::DOUBLE AS lower, (bin + 1) / 10::DOUBLE AS upper, n, round(predicted, 6) + 0.0 AS predicted, round(observed, 6) + 0.0 AS observed, round(predicted - observed, 6) + 0.0 AS error FROM rel", SCORED, _REL)
register("ece", lambda m: evaluation.ece(fixed_score(m)), "SELECT round(sum(n * abs(predicted - observed)) / sum(n), 6) + 0.0 AS ece FROM rel", SCORED, _REL)


def sliced(m: DataFrame, points: float = 0.3, lead: float = 0.1) -> DataFrame:
    """Slices of fixed_score: a player's row has what its score needs, so the match's rows meet once, with attributes and scores."""
    z = -0.6 * (F.ln("rank") - F.ln("opp_rank")) + points * (F.ln("points") - F.ln("opp_points")) + lead
    view = history.with_form(history.player_view(m)).withColumn("p", F.round(1 / (1 + F.exp(-z)), 12))
    wide = reshape.both_sides(view, ["hand", "rank", "age", "form", "p"], ["surface", "level", "best_of", "round"])
    prob = F.round((F.col("w_p") + (1 - F.col("l_p"))) / 2, 12)
    return evaluation.slices(evaluation.slice_frame(wide.withColumn("prob", prob).withColumn("correct", (F.col("prob") > 0.5).cast("int"))))


def checked_frame(m: DataFrame) -> DataFrame:
    """The slice frame, joined one to one with the evaluation; its mean must be the accuracy that the evaluation reports."""
    evaluated = stored(evaluation.match_evaluation(fixed_score(m)))
    reported = evaluated.agg(F.avg("correct")).first()[0]
    frame = m.select("match_num", "surface", "level").join(evaluated, "match_num")
    return checks.checked(frame, means=[checks.MeanCheck("match accuracy", "correct", reported)])


def _slices_sql(name: str, ev: str) -> str:
    f = lambda c: f"abs(w.{c} - l.{c})"
    frame = f"""{name}_f AS (SELECT w.surface, w.level, CAST(w.best_of AS VARCHAR) AS best_of, w.round, least(w.hand, l.hand) || '-vs-' || greatest(w.hand, l.hand) AS hands, {binned_sql(f('rank'), RANK_GAPS)} AS rank_gap, {binned_sql(f('age'), AGE_GAPS)} AS age_gap,
      {binned_sql('round(abs(wf.form - lf.form), 9)', FORM_GAPS)} AS form_gap, prob, correct FROM {ev} e JOIN pv w ON w.match_num = e.match_num AND w.side = 'w' JOIN pv l ON l.match_num = e.match_num AND l.side = 'l'
      JOIN form wf ON wf.match_num = e.match_num AND wf.side = 'w' JOIN form lf ON lf.match_num = e.match_num AND lf.side = 'l')"""
    parts = []
    cs = evaluation.SLICES
    for i, a in enumerate(cs):
        parts.append(f"SELECT 1 AS degree, '{a}=' || {a} AS slice, prob, correct FROM {name}_f")
        parts += [f"SELECT 2, '{a}=' || {a} || ' & {b}=' || {b}, prob, correct FROM {name}_f" for b in cs[i + 1 :]]
    return f"""{frame}, {name}_w AS (SELECT count(*) AS all_n, avg(correct) AS all_accuracy FROM {name}_f),
{name} AS (SELECT degree, slice, count(*) AS support, avg(correct) AS accuracy, sum(correct) AS hits, avg((1 - prob) * (1 - prob)) AS brier, avg(-ln(greatest(1e-15, least(prob, 1 - 1e-15)))) AS log_loss, avg(prob) AS mean_prob FROM ({' UNION ALL '.join(parts)}) GROUP BY degree, slice HAVING count(*) >= 5),
{name}_t AS (SELECT *, (hits / support + 1.9208 / support - 1.96 * sqrt(accuracy * (1 - accuracy) / support + 0.9604 / (support * support))) / (1 + 3.8416 / support) AS lo, (hits / support + 1.9208 / support + 1.96 * sqrt(accuracy * (1 - accuracy) / support + 0.9604 / (support * support))) / (1 + 3.8416 / support) AS hi FROM {name} CROSS JOIN {name}_w)"""


_SLICES = (PV, FORM, SCORED, _slices_sql("sl", "sc_ev"))
register("slices_1d_2d", lambda m: sliced(m).select("degree", "slice", "support", "support_share", "accuracy", "error_rate", "gap", "brier", "log_loss", "mean_prob"), f"SELECT degree, slice, support, round(support / all_n, 6) + 0.0 AS support_share, {r6('accuracy')}, round(1 - accuracy, 6) + 0.0 AS error_rate, round(accuracy - all_accuracy, 6) + 0.0 AS gap, {r6('brier', 'log_loss', 'mean_prob')} FROM sl_t", *_SLICES)
register("slice_frame_checked", lambda m: checked_frame(m).groupBy("surface").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy")), "SELECT surface, count(*) AS n, round(avg(correct), 6) + 0.0 AS accuracy FROM sc_ev JOIN matches USING (match_num) GROUP BY surface", SCORED)
register("slice_wilson", lambda m: sliced(m).select("slice", "support", "lower", "upper", "below_overall"), "SELECT slice, support, round(greatest(0, lo), 6) + 0.0 AS lower, round(least(1, hi), 6) + 0.0 AS upper, least(1, hi) < all_accuracy AS below_overall FROM sl_t", *_SLICES)
register("worst_slices", lambda m: evaluation.worst_slices(sliced(m)).select("slice", "support", "gap"), "SELECT slice, support, round(accuracy - all_accuracy, 6) + 0.0 AS gap FROM (SELECT *, accuracy - all_accuracy AS g, count(*) FILTER (accuracy - all_accuracy <= -0.05) OVER () AS k, row_number() OVER (ORDER BY accuracy - all_accuracy, support DESC, slice) AS i FROM sl_t) WHERE CASE WHEN k > 0 THEN g <= -0.05 ELSE i <= 10 END", *_SLICES)
register(
    "slice_compare",
    lambda m: evaluation.compare_slices({"full": sliced(m), "rank": sliced(m, 0.0, 0.0)}, "full"),
    "SELECT a.slice, a.degree, a.support, round(a.accuracy, 6) + 0.0 AS full_accuracy, round(b.accuracy, 6) + 0.0 AS rank_accuracy, CASE WHEN b.hits > a.hits THEN 'rank' ELSE 'full' END AS best_model, round(b.accuracy - a.accuracy, 6) + 0.0 AS rank_delta FROM sl_t a JOIN s2_t b ON a.slice = b.slice",
    *_SLICES, OTHER, _slices_sql("s2", "so_ev"),
)
register("best_slices", lambda m: evaluation.best_slices(sliced(m)).select("slice", "support", "gap"), "SELECT slice, support, round(accuracy - all_accuracy, 6) + 0.0 AS gap FROM sl_t ORDER BY accuracy - all_accuracy DESC, support DESC, slice LIMIT 8", *_SLICES)
register(
    "slice_gains_losses",
    lambda m: evaluation.gains_and_losses(evaluation.compare_slices({"full": sliced(m), "rank": sliced(m, 0.0, 0.0)}, "full"), "rank_delta"),
    "SELECT * FROM (SELECT 'gain' AS kind, slice, support, round(d, 6) + 0.0 AS delta FROM x ORDER BY d DESC, support DESC, slice LIMIT 8) UNION ALL SELECT * FROM (SELECT 'loss', slice, support, round(d, 6) + 0.0 FROM x ORDER BY d, support DESC, slice LIMIT 8)",
    *_SLICES, OTHER, _slices_sql("s2", "so_ev"), "x AS (SELECT a.slice, a.support, b.accuracy - a.accuracy AS d FROM sl_t a JOIN s2_t b ON a.slice = b.slice)",
)
register("worst_predictions", lambda m: evaluation.worst_predictions(evaluation.match_evaluation(fixed_score(m))), f"SELECT match_num, {r6('prob')}, correct, round(1 - prob, 6) + 0.0 AS error FROM sc_ev ORDER BY prob, match_num LIMIT 5", SCORED)


def pairs_of(m: DataFrame) -> DataFrame:
    base = evaluation.match_evaluation(fixed_score(m, 0.0, 0.0)).join(m.select("match_num", "season"), "match_num")
    return evaluation.paired(base, evaluation.match_evaluation(fixed_score(m)))


_PAIRS = "pr AS (SELECT o.match_num, o.season, o.correct AS a, s.correct AS b FROM so_ev o JOIN sc_ev s ON s.match_num = o.match_num)"
_mc = """count(*) AS n, count(*) FILTER (a = 1 AND b = 0) AS only_base, count(*) FILTER (a = 0 AND b = 1) AS only_other, round(avg(a), 6) + 0.0 AS base_accuracy, round(avg(b), 6) + 0.0 AS other_accuracy, round(avg(b) - avg(a), 6) + 0.0 AS delta,
 round(CASE WHEN count(*) FILTER (a <> b) > 0 THEN greatest(abs(count(*) FILTER (a = 1 AND b = 0) - count(*) FILTER (a = 0 AND b = 1)) - 1, 0) / sqrt(count(*) FILTER (a <> b)) ELSE 0 END, 6) + 0.0 AS z"""
register("mcnemar_counts", lambda m: evaluation.mcnemar(pairs_of(m)), f"SELECT {_mc} FROM pr", SCORED, OTHER, _PAIRS)
register("walkforward_by_year", lambda m: evaluation.walk_forward(pairs_of(m)), f"SELECT *, (SELECT count(*) FROM (SELECT season FROM pr GROUP BY season HAVING avg(b) > avg(a))) AS gained FROM (SELECT season, {_mc} FROM pr GROUP BY GROUPING SETS ((season), ()))", SCORED, OTHER, _PAIRS)
register("delta_correlation", lambda m: evaluation.delta_correlation(pairs_of(m)), "SELECT round(corr(x, d), 6) + 0.0 AS correlation FROM (SELECT avg(a) AS x, avg(b) - avg(a) AS d FROM pr GROUP BY season)", SCORED, OTHER, _PAIRS)
register(
    "seed_summary",
    lambda m: evaluation.summary(evaluation.mcnemar(pairs_of(m), "season"), ["base_accuracy", "other_accuracy"]),
    "SELECT metric, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std, round(stddev_pop(v), 6) + 0.0 AS std_pop, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(max(v) - min(v), 6) + 0.0 AS range FROM (SELECT 'base_accuracy' AS metric, avg(a) AS v FROM pr GROUP BY season UNION ALL SELECT 'other_accuracy', avg(b) FROM pr GROUP BY season) GROUP BY metric",
    SCORED, OTHER, _PAIRS,
)
register("half_width_ci", lambda m: pairs_of(m).groupBy("season").agg(F.count("*").alias("n"), F.avg("b").alias("accuracy")).withColumn("half_width", half_width(F.col("accuracy"), F.col("n"))), "SELECT season, count(*) AS n, round(avg(b), 6) + 0.0 AS accuracy, round(1.96 * sqrt(avg(b) * (1 - avg(b)) / count(*)), 6) + 0.0 AS half_width FROM pr GROUP BY season", SCORED, OTHER, _PAIRS)

# --- resolution: names made from player numbers, and an outside feed made from the match log

FIRST = ("Élodie", "Björn", "Zoë", "Juan", "Li", "Mário", "Åsa", "Tomás", "Nina", "Ivo", "Chloé")
LAST = ("Nováková", "O'Connell", "Auger-Aliassime", "de la Cruz", "Bu", "Sørensen", "Mpetshi Perricard", "García", "Smith", "Kvitová", "St. Clair", "Wu", "Ferrer")


def _pick(values: Sequence[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def full_name(s: Column) -> Column:
    return F.concat_ws(" ", _pick(FIRST, s % len(FIRST)), _pick(LAST, s % len(LAST)))


def short_name(s: Column) -> Column:
    return F.concat(F.replace(_pick(LAST, s % len(LAST)), F.lit("St. "), F.lit("St ")), F.lit(" "), F.substring(_pick(FIRST, s % len(FIRST)), 1, 1), F.lit("."))


def named(m: DataFrame) -> DataFrame:
    return m.select("match_num", "season", "tourney_id", "tourney_date", full_name(F.col("w_sid")).alias("w_name"), full_name(F.col("l_sid")).alias("l_name"), "w_rank", "l_rank")


def feed(m: DataFrame) -> DataFrame:
    k = F.col("match_num")
    return m.where(k % 5 != 0).select((k * 10).alias("feed_id"), F.date_add("tourney_date", (k % 20).cast("int")).alias("feed_date"), short_name(F.col("w_sid")).alias("w_short"), short_name(F.col("l_sid")).alias("l_short"), F.when(k % 3 == 0, F.col("w_rank") + 1).otherwise(F.col("w_rank")).alias("w_rank"), "l_rank")


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_plain = lambda x: f"trim(regexp_replace(regexp_replace(lower(strip_accents(replace({x}, 'ø', 'o'))), '[-''.]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NAMES = f"""nm AS (SELECT match_num, season, tourney_id, tourney_date, w_rank, l_rank, w_sid, l_sid, {", ".join(f"({_list(FIRST)})[{x}_sid % {len(FIRST)} + 1] AS {x}f, ({_list(LAST)})[{x}_sid % {len(LAST)} + 1] AS {x}s" for x in "wl")} FROM matches),
fk AS (SELECT match_num AS k, match_num * 10 AS feed_id, tourney_date + CAST(match_num % 20 AS INT) AS feed_date, CASE WHEN match_num % 3 = 0 THEN w_rank + 1 ELSE w_rank END AS w_rank, l_rank, {", ".join(f"{_plain(f'{x}s')} AS {x}s, substr({_plain(f'{x}f')}, 1, 1) AS {x}i" for x in "wl")} FROM nm WHERE match_num % 5 <> 0),
full_ AS (SELECT match_num, season, tourney_id, tourney_date, w_rank, l_rank, {", ".join(f"{_plain(f'{x}f')} AS {x}f, {_plain(f'{x}s')} AS {x}s" for x in "wl")} FROM nm),
tk AS (SELECT DISTINCT f, s, str_split(f || ' ' || s, ' ') AS t FROM (SELECT wf AS f, ws AS s FROM full_ UNION SELECT lf, ls FROM full_)),
ky AS (SELECT f, s, surname || '|' || i AS key, surname FROM (SELECT f, s, unnest([n, replace(n, ' ', '')]) AS surname, i FROM (
   SELECT f, s, array_to_string(t[a:b], ' ') AS n, substr(t[1], 1, 1) AS i FROM tk, range(2, 6) x(a), range(2, 6) y(b) WHERE a <= b AND b <= len(t)
   UNION SELECT f, s, array_to_string(t[1:b], ' '), substr(t[len(t)], 1, 1) FROM tk, range(1, 6) y(b) WHERE b < len(t))) GROUP BY ALL),
fn AS (SELECT *, ws || '|' || wi AS wk, replace(ws, ' ', '') || '|' || wi AS wk2, ls || '|' || li AS lk, replace(ls, ' ', '') || '|' || li AS lk2 FROM fk),
np AS (SELECT a.f AS wf, a.s AS ws, b.f AS lf, b.s AS ls, n.wk, n.lk FROM (SELECT DISTINCT wk, wk2, lk, lk2 FROM fn) n JOIN ky a ON a.key = n.wk OR a.key = n.wk2 JOIN ky b ON b.key = n.lk OR b.key = n.lk2 GROUP BY ALL),
cand AS (SELECT DISTINCT m.match_num, n.feed_id, CAST(m.w_rank = n.w_rank AS INT) + CAST(m.l_rank = n.l_rank AS INT) AS agreement, date_diff('day', m.tourney_date, n.feed_date) AS day_gap
   FROM full_ m JOIN np USING (wf, ws, lf, ls) JOIN fn n ON n.wk = np.wk AND n.lk = np.lk WHERE date_diff('day', m.tourney_date, n.feed_date) BETWEEN -3 AND 27),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_num ORDER BY agreement DESC, abs(day_gap), feed_id) AS i FROM cand) WHERE i = 1)"""
register("name_keys", lambda m: named(m).select("w_name", F.explode(resolution.full_name_keys(F.col("w_name"))).alias("key")).distinct(), "SELECT DISTINCT m.wf0 || ' ' || m.ws0 AS w_name, key FROM (SELECT DISTINCT wf AS wf0, ws AS ws0, " + f"{_plain('wf')} AS f, {_plain('ws')} AS s" + " FROM nm) m JOIN ky USING (f, s)", _NAMES)
register("interval_candidates", lambda m: resolution.candidates(named(m), feed(m)), "SELECT match_num, feed_id, agreement, day_gap FROM cand", _NAMES)
register("best_candidate", lambda m: resolution.best(resolution.candidates(named(m), feed(m))), "SELECT match_num, feed_id, agreement, day_gap FROM bst", _NAMES)
register("unmatched_report", lambda m: resolution.unmatched(named(m), resolution.best(resolution.candidates(named(m), feed(m))), "tourney_id"), "SELECT tourney_id, count(*) AS n FROM full_ WHERE match_num NOT IN (SELECT match_num FROM bst) GROUP BY tourney_id ORDER BY n DESC, tourney_id LIMIT 5", _NAMES)
register("fuzzy_match", lambda m: resolution.match_once(named(m), feed(m)).drop("stage"))
register("fuzzy_fallback", lambda m: resolution.with_fallback(named(m), feed(m)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.page_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES["page_links"] = _links
ORACLES["page_links"] = """SELECT page_id, CAST(place AS INT) AS place, href FROM (SELECT page_id, unnest(range(len(l))) AS place, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))"""

# --- models (results differ between engines: rows only)


def _parts(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = stored(reshape.sample(history.baseline(m)))  # each pass of a fit would compute the windows again
    return s.where("season < 1996"), s.where("season = 1996"), s.where("season >= 1997")


def _predicted(kind: Callable[[], object]) -> Callable[[DataFrame], DataFrame]:
    def build(m: DataFrame) -> DataFrame:
        train, _, test = _parts(m)
        return models.predict(models.fit(train, kind()), test).select("match_num", "y", "p")

    return build


def _platt(m: DataFrame) -> DataFrame:
    train, val, test = _parts(m)
    return models.platt(models.fit(train, models.forest()), val, test).select("match_num", "y", "p")


def _importance(m: DataFrame) -> DataFrame:
    train, _, _ = _parts(m)
    return models.importance(m.sparkSession, models.fit(train, models.forest()))


def _ablation(m: DataFrame) -> DataFrame:
    train, _, test = _parts(m)
    return evaluation.walk_forward(models.compare(train, test, models.FEATURES[:8], models.FEATURES))


register("rf_baseline", _predicted(models.forest))
register("gbt", _predicted(models.boosting))
register("logreg", _predicted(models.logistic))
register("platt", _platt)
register("importance", _importance)
register("ablation_walk_forward", _ablation)
