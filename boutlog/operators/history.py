"""Features from a player's earlier matches, strictly before the row.

Everything is a window over one player view. The view is dealt by player once; every window is
partitioned by the player and possibly more, so it needs only a sort, and windows of equal keys share it. Frames are bounded:
"the last n matches that meet a condition" are lags that skip the others, so no history is collected into an array that grows;
the last n recent ones are lags too (on the surface an array of at most n, so that extended() needs no more sorts). extended() takes
all of its contexts from one ordered pass (tails.py).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.functions.columns import LEVEL_STRENGTH, LEVEL_STRENGTH_UNKNOWN, SERVE_PRIORS, SHARES, binned, encoded, seed_context, serve_score_sql, share_sql  # noqa: F401
from boutlog.operators.tails import known, tails
from boutlog.session import dealt
from boutlog.sources.match_log import SERVE

ORDER = ("tourney_date", "match_num")
RECENT_DAYS = 365
LATE_ROUNDS = ("QF", "SF", "BR", "F")
_PLAYER = ("rank", "points", "age", "ht", "hand", "seed")


def side_columns(x: str, y: str) -> dict[str, str]:
    """The player view's columns of side x against y, as SQL over the match log."""
    out = {c: c for c in ("match_num", "tourney_date", "tourney_id", "season", "surface", "level", "best_of", "round", "minutes", "draw_size")}
    out |= {"side": f"'{x}'", "player": f"{x}_sid", "opponent": f"{y}_sid", "is_win": f"cast({int(x == 'w')} as double)"}
    out |= {c: f"{x}_{c}" for c in (*SERVE, *_PLAYER)}
    out |= {f"o_{c}": f"{y}_{c}" for c in ("svpt", "first_won", "second_won")}
    return out | {f"opp_{c}": f"{y}_{c}" for c in ("rank", "points", "hand")}


def player_view(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each player, with the shares of the match; dealt by player."""
    sides = [F.struct(*[F.expr(e).alias(n) for n, e in side_columns(x, y).items()]) for x, y in ("wl", "lw")]
    view = matches.select(F.inline(F.array(*sides)))
    return dealt(view.select("*", *[F.expr(share_sql(n)).alias(n) for n in SHARES]), "player")


def before(*keys: str) -> object:
    return Window.partitionBy("player", *keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)


def _last(n: int, *keys: str) -> object:
    return Window.partitionBy("player", *keys).orderBy(*ORDER).rowsBetween(-n, -1)


def _kept(array: Column) -> Column:
    return F.filter(array, lambda x: x["d"] >= F.date_sub(F.col("tourney_date"), RECENT_DAYS))


def _mean(array: Column, field: str) -> Column:
    """Mean of the non-null values of a field; null without any."""
    values = F.filter(F.transform(array, lambda x: x[field]), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def _recent(view: DataFrame, n: int, fields: Sequence[str]) -> tuple[DataFrame, dict[str, list[Column]], list[str]]:
    """view with lags of the last n matches; of each field its values there, the oldest first, null out of the last RECENT_DAYS days; the lags' names."""
    w, lagged = Window.partitionBy("player").orderBy(*ORDER), [f"_l{i}" for i in range(n, 0, -1)]
    held = view.withColumn("_v", F.struct(F.col("tourney_date").alias("d"), *fields)).withColumns({f"_l{i}": F.lag("_v", i).over(w) for i in range(1, n + 1)})
    since = F.date_sub(F.col("tourney_date"), RECENT_DAYS)
    return held, {f: [F.when(F.col(f"{x}.d") >= since, F.col(f"{x}.{f}")) for x in lagged] for f in fields}, ["_v", *lagged]


def with_form(view: DataFrame, n: int = 10, recent: bool = True, name: str = "form") -> DataFrame:
    """Share of wins in the last n matches (of the last RECENT_DAYS days); 0.5 without any."""
    if not recent:
        return view.withColumn(name, F.coalesce(F.avg("is_win").over(_last(n)), F.lit(0.5)))
    held, values, made = _recent(view, n, ["is_win"])
    return held.withColumn(name, F.coalesce(Measure("mean").of(values["is_win"]), F.lit(0.5))).drop(*made)


def with_surface_form(view: DataFrame, n: int = 10, least: int = 3) -> DataFrame:
    """The same on the row's surface; under ``least`` matches: form."""
    held = F.collect_list(F.struct(F.col("tourney_date").alias("d"), F.col("is_win").alias("v"))).over(_last(n, "surface"))
    out = view.withColumn("_h", held).withColumn("_r", _kept(F.col("_h")))
    return out.withColumn("surface_form", F.when(F.size("_r") >= least, _mean(F.col("_r"), "v")).otherwise(F.col("form"))).drop("_h", "_r")


def with_serve(view: DataFrame, n: int = 10) -> DataFrame:
    """avg_<share>: mean over the last n recent matches in which the share is defined; its prior without any."""
    held, values, made = _recent(view, n, list(SHARES))
    return held.select("*", *[F.coalesce(Measure("mean").of(values[s]), F.lit(SERVE_PRIORS[s])).alias(f"avg_{s}") for s in SHARES]).drop(*made)


def with_form_and_serve(view: DataFrame, n: int = 10) -> DataFrame:
    """with_form and with_serve from one set of lags."""
    held, values, made = _recent(view, n, ["is_win", *SHARES])
    mean = lambda c, prior: F.coalesce(Measure("mean").of(values[c]), F.lit(prior))
    return held.select("*", mean("is_win", 0.5).alias("form"), *[mean(s, SERVE_PRIORS[s]).alias(f"avg_{s}") for s in SHARES]).drop(*made)


def with_h2h(view: DataFrame) -> DataFrame:
    """Wins minus losses against the same opponent so far."""
    return view.withColumn("h2h", F.coalesce(F.sum(F.col("is_win") * 2 - 1).over(before("opponent")), F.lit(0.0)))


def with_rest(view: DataFrame, most: int = 60) -> DataFrame:
    """Days since the previous match's date (0 to ``most``; ``most`` without one) and minutes played in this tournament."""
    gap = F.datediff("tourney_date", F.lag("tourney_date").over(Window.partitionBy("player").orderBy(*ORDER)))
    return view.withColumns({"rest_days": F.when(gap.isNull(), most).otherwise(F.least(F.greatest(gap, F.lit(0)), F.lit(most))).cast("double"), "tourney_minutes": F.coalesce(F.sum("minutes").over(before("tourney_id")), F.lit(0.0))})


def with_path(view: DataFrame) -> DataFrame:
    """Mean log strength of earlier opponents in this tournament, and their number."""
    w = before("tourney_id")
    return view.withColumns({"path_strength": F.coalesce(F.avg(F.log1p(F.greatest("opp_points", F.lit(1)).cast("double"))).over(w), F.lit(0.0)), "path_matches": F.count(F.lit(1)).over(w).cast("double")})


@dataclass(frozen=True)
class Context:
    """The last ``n`` earlier matches that meet ``condition`` and equal the row in ``keys``."""

    condition: str = "true"
    keys: tuple[str, ...] = ()
    n: int = 10


@dataclass(frozen=True)
class Measure:
    """Of the matches in a context: their count (of those with a value, if a column is given), or the value's mean or population deviation."""

    kind: str
    value: str | None = None

    def over(self, window: object) -> Column:
        return {"count": F.count, "mean": F.avg, "deviation": F.stddev_pop}[self.kind](F.lit(1) if self.value is None else self.value).over(window)

    def of(self, held: Sequence[Column]) -> Column:
        """The same of up to n values at hand, the oldest first."""
        count = sum(x.isNotNull().cast("long") for x in held)
        if self.kind == "count":
            return count
        mean = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in held), F.lit(0.0)), count)
        if self.kind == "mean":
            return mean
        return F.sqrt(F.try_divide(sum((F.coalesce((x - F.col("_mean")) * (x - F.col("_mean")), F.lit(0.0)) for x in held), F.lit(0.0)), count))


def tail(view: DataFrame, context: Context, **measures: Measure) -> DataFrame:
    """view with the measures over the context; no count, or a count of 0, and null otherwise, where no earlier match is in it.

    Matches that meet a condition are reached by their place among those that do (lags that skip the others), in the one order of
    the player's (and keys') matches: contexts of equal keys, one after the other, share a sort. Measures that tails() made are taken.
    """
    names = list(measures)
    made = {k: known(context, m.kind, m.value) for k, m in measures.items()}
    if set(made.values()) <= set(view.columns):
        return view.withColumns({k: F.col(c) for k, c in made.items()})
    if context.condition == "true":
        w = _last(context.n, *context.keys)
        return view.withColumns({k: m.over(w) for k, m in measures.items()})
    flag = F.coalesce(F.expr(context.condition), F.lit(False))
    values = [m.value for m in measures.values() if m.value is not None]
    held = F.when(flag, F.struct(F.lit(True).alias("there"), *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]))
    order = f"PARTITION BY {', '.join(('player', *context.keys))} ORDER BY {', '.join(ORDER)}"
    if not values:  # only how many there are
        return view.withColumns({k: F.least(F.count(F.when(flag, 1)).over(before(*context.keys)), F.lit(context.n)) for k in names})
    lagged = [f"_l{i}" for i in range(context.n, 0, -1)]
    out = view.withColumn("_v", held).withColumns({f"_l{i}": F.expr(f"lag(_v, {i}) IGNORE NULLS OVER ({order})") for i in range(1, context.n + 1)})
    for k, m in measures.items():
        field = "there" if m.value is None else f"v{values.index(m.value)}"
        of = [F.col(f"{x}.{field}") for x in lagged]
        if m.kind == "deviation":
            out = out.withColumn("_mean", Measure("mean").of(of))
        out = out.withColumn(k, m.of(of))
    return out.drop("_v", "_mean", *lagged)


_LATE = "round IN ('QF', 'SF', 'BR', 'F')"
#: name -> (context, least number of matches, fallback column)
FORMS: dict[str, tuple[Context, int, str]] = {
    "best_of5_form": (Context("best_of = 5", (), 8), 2, "form"),
    "late_round_form": (Context(_LATE, (), 8), 2, "form"),
    "vs_hand_form": (Context("true", ("opp_hand",), 12), 3, "form"),
    "qf_form": (Context("round = 'QF'", (), 6), 1, "form"),
    "qf_surface_form": (Context("round = 'QF'", ("surface",), 4), 1, "surface_form"),
    "vs_hand_surface_form": (Context("true", ("opp_hand", "surface"), 8), 2, "surface_form"),
    "best_of5_surface_form": (Context("best_of = 5", ("surface",), 6), 1, "surface_form"),
    "best_of5_top30_form": (Context("best_of = 5 AND opp_rank <= 30", (), 6), 1, "best_of5_form"),
    "long_match_form": (Context("minutes >= 150", (), 10), 2, "form"),
}
#: name -> (context, scale)
EXPERIENCES: dict[str, tuple[Context, int]] = {
    "best_of5_experience": (Context("best_of = 5", (), 20), 6),
    "late_round_experience": (Context(_LATE, (), 20), 6),
    "qf_experience": (Context("round = 'QF'", (), 16), 4),
    "long_match_experience": (Context("minutes >= 150", (), 20), 6),
}
#: name -> (context, least number of matches, fallback profile)
PROFILES: dict[str, tuple[Context, int, str]] = {
    "best_of5_serve": (Context("best_of = 5", (), 8), 2, "own"),
    "late_serve": (Context("round IN ('QF', 'SF', 'BR', 'F')", (), 8), 2, "own"),
    "surface_serve": (Context("true", ("surface",), 8), 2, "own"),
    "vs_hand_serve": (Context("true", ("opp_hand",), 10), 2, "surface_serve"),
    "top20_serve": (Context("opp_rank <= 20", (), 8), 2, "surface_serve"),
    "top30_serve": (Context("opp_rank <= 30", (), 8), 2, "surface_serve"),
    "top40_serve": (Context("opp_rank <= 40", (), 8), 2, "surface_serve"),
}
PROFILE = ("score", "return", "stability")
MINUTES = (Context("true", (), 12), Context("best_of = 5", (), 8))


def with_context_form(view: DataFrame, name: str) -> DataFrame:
    context, least, fallback = FORMS[name]
    out = tail(view, context, _n=Measure("count"), _wins=Measure("mean", "is_win"))
    return out.withColumn(name, F.when(F.col("_n") >= least, F.col("_wins")).otherwise(F.col(fallback))).drop("_n", "_wins")


def with_experience(view: DataFrame, name: str) -> DataFrame:
    context, scale = EXPERIENCES[name]
    out = tail(view, context, _n=Measure("count"))
    return out.withColumn(name, F.least(F.coalesce("_n", F.lit(0)) / F.lit(float(scale)), F.lit(1.0))).drop("_n")


def with_hand_balance(view: DataFrame, n: int = 20, least: int = 3) -> DataFrame:
    """(wins - losses) / matches of the last n against the opponent's hand; 0 under ``least``."""
    out = tail(view.withColumn("_w", F.col("is_win") * 2 - 1), Context("true", ("opp_hand",), n), _n=Measure("count"), _b=Measure("mean", "_w"))
    return out.withColumn("vs_hand_balance", F.when(F.col("_n") >= least, F.col("_b")).otherwise(0.0)).drop("_n", "_b", "_w")


def with_minutes(view: DataFrame) -> DataFrame:
    """Mean minutes of the last 12 matches, and of the last 8 best-of-five ones: nulls are dropped after the cut."""
    for name, context, least, fallback in (("avg_minutes", MINUTES[0], 3, F.lit(110.0)), ("best_of5_avg_minutes", MINUTES[1], 2, F.col("avg_minutes"))):
        view = tail(view, context, _n=Measure("count", "minutes"), _m=Measure("mean", "minutes"))
        view = view.withColumn(name, F.when(F.col("_n") >= least, F.col("_m")).otherwise(fallback)).drop("_n", "_m")
    return view


def _match_scores() -> dict[str, Column]:
    return {"_s": F.expr(serve_score_sql(substitute=True)), "_t": F.coalesce("return_pts_won", F.lit(SERVE_PRIORS["return_pts_won"]))}


def with_profiles(view: DataFrame, names: Sequence[str]) -> DataFrame:
    """<name>_score, _return, _stability. Priors stand in for undefined shares of a match; own averages where matches are too few."""
    view = view.withColumns(_match_scores())
    view = view.withColumns({"own_score": F.expr(serve_score_sql("avg_")), "own_return": F.col("avg_return_pts_won"), "own_stability": F.lit(0.5)})
    for name in sorted(names, key=lambda n: PROFILES[n][0].keys):  # contexts of equal keys share a sort
        view = tail(view, PROFILES[name][0], **{f"_n_{name}": Measure("count"), f"_a_{name}": Measure("mean", "_s"), f"_b_{name}": Measure("mean", "_t"), f"_c_{name}": Measure("deviation", "_s")})
    for name in names:
        _, least, fallback = PROFILES[name]
        got = {"score": F.col(f"_a_{name}"), "return": F.col(f"_b_{name}"), "stability": 1 / (1 + F.col(f"_c_{name}"))}
        view = view.withColumns({f"{name}_{k}": F.when(F.col(f"_n_{name}") >= least, got[k]).otherwise(F.col(f"{fallback}_{k}")) for k in PROFILE})
    return view.drop("_s", "_t", *[f"_{x}_{name}" for name in names for x in "nabc"])


def with_chosen_profiles(view: DataFrame) -> DataFrame:
    """top_opp_serve by the level's rank threshold; pressure_serve by best-of-five or late round."""
    out = with_profiles(view, list(PROFILES))
    level = F.col("level")
    pick = lambda k: F.when(level.isin("G", "M"), F.col(f"top20_serve_{k}")).when(level.isin("500", "A", "F"), F.col(f"top30_serve_{k}")).otherwise(F.col(f"top40_serve_{k}"))
    press = lambda k: F.when(F.col("best_of") == 5, F.col(f"best_of5_serve_{k}")).when(F.col("round").isin(*LATE_ROUNDS), F.col(f"late_serve_{k}")).otherwise(F.col(f"own_{k}"))
    return out.withColumns({**{f"top_opp_serve_{k}": pick(k) for k in PROFILE}, **{f"pressure_serve_{k}": press(k) for k in PROFILE}})


def with_endurance(view: DataFrame) -> DataFrame:
    """The weighted mix of long-match features."""
    minutes = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("best_of5_avg_minutes") - 90) / 120))
    return view.withColumn("endurance", 0.25 * F.col("best_of5_form") + 0.20 * F.col("long_match_form") + 0.15 * F.col("best_of5_experience") + 0.10 * F.col("long_match_experience") + 0.15 * minutes + 0.15 * F.col("best_of5_serve_stability"))


def with_seed_context(view: DataFrame) -> DataFrame:
    strength = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVEL_STRENGTH.items() for x in kv])[F.col("level")], F.lit(LEVEL_STRENGTH_UNKNOWN))
    return view.withColumns({"seed_context": seed_context(F.col("seed"), F.col("rank"), F.col("draw_size")), "level_strength": strength})


def baseline(matches: DataFrame) -> DataFrame:
    """The player view with form, surface form, serve averages and head-to-head: one shuffle."""
    return with_h2h(with_surface_form(with_form_and_serve(player_view(matches))))


#: Every context of extended(), with what is measured over it.
_MEASURED = (
    *[(c, [("count", None)]) for c, _ in EXPERIENCES.values()],
    *[(c, [("count", None), ("mean", "is_win")]) for c, _, _ in FORMS.values()],
    *[(c, [("count", "minutes"), ("mean", "minutes")]) for c in MINUTES],
    *[(c, [("count", None), ("mean", "_s"), ("mean", "_t"), ("deviation", "_s")]) for c, _, _ in PROFILES.values()],
    (Context("true", ("opp_hand",), 20), [("count", None), ("mean", "_w")]),
)


def extended(matches: DataFrame) -> DataFrame:
    """baseline and every context feature. Windows come first, as they share the player's shuffle; then all contexts are one pass."""
    view = with_path(with_rest(baseline(matches)))
    view = tails(view.withColumns({**_match_scores(), "_w": F.col("is_win") * 2 - 1}), _MEASURED)
    made = [c for c in view.columns if c.startswith("_k")]
    for name in EXPERIENCES:
        view = with_experience(view, name)
    for name in FORMS:
        view = with_context_form(view, name)
    return with_seed_context(with_endurance(with_hand_balance(with_chosen_profiles(with_minutes(view))))).drop(*made)


_FIRST_FORMS = ("best_of5_form", "best_of5_experience", "late_round_form", "late_round_experience", "vs_hand_form", "qf_form", "qf_experience", "qf_surface_form", "vs_hand_surface_form", "vs_hand_balance")
#: Features that each variant adds to the baseline: (of the match, of each player, with their difference): 33, 39 and 60 columns.
VARIANTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "sliceaware": (("is_bo5", "is_qf", "one_lefty"), _FIRST_FORMS),
    "bestof5": (
        ("is_bo5", "level_strength", "bo5_pressure"),
        ("best_of5_form", "best_of5_surface_form", "best_of5_top30_form", "best_of5_experience", "best_of5_avg_minutes", "long_match_form", "long_match_experience", "best_of5_serve_score", "best_of5_serve_return", "best_of5_serve_stability", "bo5_pressure_score", "endurance"),
    ),
    "qfserve": (
        ("is_bo5", "is_qf", "one_lefty", "level_strength", "qf_pressure", "bo5_pressure"),
        (*_FIRST_FORMS, "seed_context", "path_strength", "path_matches", "surface_serve_score", "top_opp_serve_score", "vs_hand_serve_return", "surface_serve_stability", "pressure_serve_score"),
    ),
}


def with_variants(view: DataFrame) -> DataFrame:
    """extended() with the flags of the match, and the pressure score that knows best-of-five alone."""
    bo5, qf = (F.col("best_of") == 5).cast("int"), (F.col("round") == "QF").cast("int")
    one = ((F.col("hand") == "L") != (F.col("opp_hand") == "L")).cast("int")
    score = F.when(F.col("best_of") == 5, F.col("best_of5_serve_score")).otherwise(F.expr(serve_score_sql("avg_")))
    return view.withColumns({"is_bo5": bo5, "is_qf": qf, "one_lefty": one, "bo5_pressure": F.col("level_strength") * bo5, "qf_pressure": F.col("level_strength") * qf, "bo5_pressure_score": score})
