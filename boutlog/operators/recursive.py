"""Recursive state: exponentially weighted averages (one ordered pass per player) and Elo ratings (one ordered pass per tour)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from boutlog.functions.columns import SERVE_PRIORS, SHARES
from boutlog.operators.history import ORDER, player_view, with_h2h
from boutlog.operators.reshape import both_sides, encode, symmetrize

ALPHA, ALPHA_LONG = 0.18, 0.05
LOWER_IS_BETTER = ("df_rate", "bp_faced_per_game")
BLOCK = 512  # rows that are computed together
#: The ten measures of momentum, each with its prior.
MEASURES = {"is_win": 0.5, **SERVE_PRIORS, "serve_pts_won": 0.62}
#: What averages read of a player view: its rows go through Python, so queries that keep no more leave the other columns out first.
NEEDED = ("match_num", "side", "player", "tourney_date", "is_win", "svpt", "first_won", "second_won", *SHARES)


@dataclass(frozen=True)
class Average:
    """An exponentially weighted average of the earlier defined values of a column, each new one with weight alpha.

    It starts at ``prior``; where no value has come yet it reads as ``unseen``, if that is given: a state may start from one
    seed and be read from another (which may be another average). It runs over the rows that equal in ``keys``.
    """

    value: str
    prior: Column | float
    name: str
    alpha: float = ALPHA
    unseen: Column | None = None
    keys: tuple[str, ...] = ()


def _doubled(factor: np.ndarray, added: np.ndarray, begins: np.ndarray, start: np.ndarray, block: int) -> np.ndarray:
    """Averages (a row each) before every row (a column each); a row takes an average a to factor * a + added, begins are where one starts anew.

    Such steps are put together by doubling: after log2(block) rounds over the rows of a block each holds all steps since its begin.
    """
    n = len(begins)
    a, b = np.zeros(factor.shape), np.zeros(factor.shape)
    a[:, 1:], b[:, 1:] = factor[:, :-1], added[:, :-1]
    a[:, begins], b[:, begins] = 0.0, start
    odd = not np.isfinite(b).all()
    for at in range(0, n, block):
        p, q = a[:, at : at + block], b[:, at : at + block]
        if not begins[at]:  # goes on from the row before
            p[:, 0], q[:, 0] = 0.0, factor[:, at - 1] * b[:, at - 1] + added[:, at - 1]
        step = 1
        while step < p.shape[1] and p.any():
            more = p[:, step:] * q[:, :-step]
            if odd:  # nothing of other players, be it infinite
                more[p[:, step:] == 0] = 0.0
            q[:, step:] += more
            p[:, step:] *= p[:, :-step].copy()
            step *= 2
    return b


def _averaged(batch: pa.RecordBatch, keys: Sequence[str], values: Sequence[str], alphas: np.ndarray, priors: Sequence[float | str], held: dict, block: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(averages before each row, whether a value came before it, states of the last player by its keys) of a batch of players' rows in order; ``held`` are the states before it."""
    doubles = lambda c: np.asarray(c.cast(pa.float64()).fill_null(np.nan))
    n, begins = batch.num_rows, np.asarray(batch.column("_i")) == 1
    player = np.cumsum(begins)  # 0: goes on from the batch before
    code = player
    for c in keys:
        found = batch.column(c).dictionary_encode()
        code = code * (len(found.dictionary) + 1) + np.asarray(found.indices.fill_null(len(found.dictionary)))
    order = np.argsort(code, kind="stable")
    begins = np.append(True, np.diff(code[order]) != 0)
    first = np.flatnonzero(begins)
    named = list(zip(*(batch.column(c).take(pa.array(order[first])).to_pylist() for c in keys))) if keys else [()] * len(first)
    whose = player[order[first]]

    start = np.array([doubles(batch.column(p))[order[first]] if isinstance(p, str) else np.full(len(first), p) for p in priors])
    seen = np.zeros(start.shape, bool)
    for g in np.flatnonzero(whose == 0):
        if named[g] in held:
            start[:, g], seen[:, g] = held[named[g]]
    taken = [batch.column(v).cast(pa.float64()) for v in values]
    there = np.array([np.asarray(c.is_valid())[order] for c in taken])
    factor = np.where(there, 1 - alphas[:, None], 1.0)
    added = np.where(there, alphas[:, None] * np.array([np.asarray(c.fill_null(0.0))[order] for c in taken]), 0.0)
    b = _doubled(factor, added, begins, start, block)
    group = np.cumsum(begins) - 1
    before_ = np.cumsum(there, axis=1) - there
    came = seen[:, group] | (before_ > before_[:, first][:, group])

    end = np.append(first[1:], n) - 1
    after, seen = factor[:, end] * b[:, end] + added[:, end], came[:, end] | there[:, end]
    left = dict(held) if player[-1] == 0 else {}
    left.update({named[g]: (after[:, g], seen[:, g]) for g in np.flatnonzero(whose == player[-1])})
    out, some = np.empty_like(b), np.empty_like(came)
    out[:, order], some[:, order] = b, came
    return out, some, left


def with_averages(view: DataFrame, averages: Sequence[Average], keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """view with all averages, over the player's (and keys') rows in time order; null where the player or a key is null.

    One pass: rows are put in order where the player's rows are (no shuffle for a view that is dealt by player) and streamed; what is
    held is a batch and the last player's states, so a player may have any number of rows. ``block`` rows are computed together. A
    prior that is a column is read at the first row. Nothing is joined or computed twice, and there is one sort, whatever the averages and keys.
    """
    if max(-math.log(1 - a.alpha) for a in averages) * block > 700:
        raise ValueError("powers of 1 - alpha over a block leave the range of doubles: take smaller blocks")
    names, late = [a.name for a in averages], [a.unseen is not None for a in averages]
    of = [("player", *keys, *a.keys) for a in averages]
    at = {g: [j for j, x in enumerate(of) if x == g] for g in of}
    values, alphas = [a.value for a in averages], np.array([a.alpha for a in averages])
    priors = [a.prior if isinstance(a.prior, float) else f"_p{j}" for j, a in enumerate(averages)]
    kept = [c for c in view.columns if c not in names]
    rows = view.withColumns({"_i": F.row_number().over(Window.partitionBy("player").orderBy(*ORDER)), **{p: a.prior for p, a in zip(priors, averages) if isinstance(p, str)}})
    rows = rows.sortWithinPartitions("player", *ORDER)  # is so already, unless other windows were put between

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = {g: {} for g in at}, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            places = np.append(place, np.asarray(batch.column("_i")))
            if not ((places[1:] == 1) | (places[1:] == places[:-1] + 1)).all():
                raise RuntimeError("rows are not in the order of their window")
            place = places[-1]
            made = {}
            for g, js in at.items():
                pick = lambda x: [x[j] for j in js]  # noqa: B023, E731
                found, came, held[g] = _averaged(batch, g[1:], pick(values), alphas[js], pick(priors), held[g], block)
                none = ~np.logical_and.reduce([np.asarray(batch.column(c).is_valid()) for c in g])
                made |= {names[j]: pa.array(x, pa.float64(), mask=none | ~some if late[j] else none) for j, x, some in zip(js, found, came)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(made[c] for c in names)], names=[*kept, *names])

    schema = T.StructType([*(view.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])
    known = lambda g: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in g])
    unseen = {a.name: F.when(known(g), F.coalesce(a.name, a.unseen)) for a, g in zip(averages, of) if a.unseen is not None}
    out = rows.mapInArrow(run, schema)
    return out.withColumns(unseen) if unseen else out


def with_ewma(view: DataFrame, value: str, prior: Column, name: str, alpha: float = ALPHA, keys: tuple[str, ...] = ()) -> DataFrame:
    """The average of the earlier defined values of one column."""
    return with_averages(view, [Average(value, prior, name, alpha)], keys)


def with_ewma_form(view: DataFrame) -> DataFrame:
    return with_ewma(view, "is_win", F.lit(0.5), "ewma_form")


def with_ewma_surface_form(view: DataFrame) -> DataFrame:
    """Per surface, from the general average before the first match there on."""
    seeded = view.withColumn("_p", F.first("ewma_form").over(Window.partitionBy("player", "surface").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    return with_ewma(seeded, "is_win", F.col("_p"), "ewma_surface_form", keys=("surface",)).drop("_p")


def with_ewma_serve(view: DataFrame) -> DataFrame:
    return with_averages(view, [Average(s, SERVE_PRIORS[s], f"ewma_{s}") for s in SHARES])


def with_momentum(view: DataFrame, *more: Average) -> DataFrame:
    """Short and long averages of ten measures (short_<measure>, long_<measure>), ``more`` averages, and from them
    momentum: mean sign of short minus long; completeness: serve points won times return points won."""
    view = view.withColumn("serve_pts_won", F.when(F.col("svpt") > 0, (F.col("first_won") + F.col("second_won")) / F.col("svpt")))
    averages = [Average(v, p, f"{kind}_{v}", alpha) for v, p in MEASURES.items() for kind, alpha in (("short", ALPHA), ("long", ALPHA_LONG))]
    view = with_averages(view, [*averages, *more])
    signs = []
    for value in MEASURES:
        sign = F.signum(F.round(F.col(f"short_{value}") - F.col(f"long_{value}"), 12))
        signs.append(-sign if value in LOWER_IS_BETTER else sign)
    return view.withColumns({"momentum": sum(signs[1:], signs[0]) / 10, "completeness": F.col("short_serve_pts_won") * F.col("short_return_pts_won")})


def with_dual_horizon(view: DataFrame) -> DataFrame:
    """with_momentum, and short_surface_form: the short average of wins on the surface.

    Its state starts at 0.5 with the first match there, while before that match it reads as the short average over all surfaces.
    """
    return with_momentum(view, Average("is_win", 0.5, "short_surface_form", unseen=F.col("short_is_win"), keys=("surface",)))


#: Per-player columns of the two-horizon sample.
DUAL = ("rank_log", "points_log", "age", "ht", "is_lefty", "form_short", "form_long", "surface_form", "momentum", "serve_advantage", "completeness", *SHARES)


def dual_horizon_sample(matches: DataFrame) -> DataFrame:
    """The two-perspective sample of the two-horizon model: 48 features, of short and long averages instead of last-n means.

    A player's serve advantage takes the opponent's returns from the same match row, so no match is joined with itself.
    """
    view = player_view(matches).select(*NEEDED, "opponent", "surface", "level", "round", "season", "best_of", *("rank", "points", "age", "ht", "hand"))
    view = encode(with_dual_horizon(with_h2h(view)))
    view = view.withColumns({"rank_log": F.ln("rank"), "points_log": F.ln("points"), "is_lefty": F.coalesce((F.col("hand") == "L").cast("int"), F.lit(0))})
    view = view.drop(*SHARES).withColumnsRenamed({"short_is_win": "form_short", "long_is_win": "form_long", "short_surface_form": "surface_form", **{f"short_{s}": s for s in SHARES}})
    carry = ["season", "tourney_date", "surface_code", "level_code", "best_of", "round_code"]
    wide = both_sides(view, [*[c for c in DUAL if c != "serve_advantage"], "short_serve_pts_won", "h2h"], carry).withColumn("h2h", F.col("w_h2h"))
    wide = wide.withColumns({f"{x}_serve_advantage": F.col(f"{x}_short_serve_pts_won") - F.col(f"{y}_return_pts_won") for x, y in ("wl", "lw")})
    return symmetrize(wide, DUAL, ["rank_log", "points_log", "age", "ht", "form_short"], ["h2h"], carry)


def serve_advantage(view: DataFrame) -> DataFrame:
    """match_num, side, serve_advantage: own serve points won less the opponent's return points won (with_momentum's columns)."""
    mine = F.max(F.when(F.col("side") == "w", F.struct("short_serve_pts_won", "short_return_pts_won")))
    other = F.max(F.when(F.col("side") == "l", F.struct("short_serve_pts_won", "short_return_pts_won")))
    both = view.groupBy("match_num").agg(mine.alias("w"), other.alias("l"))
    row = lambda x, y: F.struct(F.lit(x).alias("side"), (F.col(f"{x}.short_serve_pts_won") - F.col(f"{y}.short_return_pts_won")).alias("serve_advantage"))
    return both.select("match_num", F.inline(F.array(row("w", "l"), row("l", "w"))))


# --- Elo

INITIAL = 1500.0


def k_factor(n: int) -> float:
    return 250.0 / (n + 5) ** 0.4


def elo(matches: DataFrame, tour: Column | None = None) -> DataFrame:
    """match_num, w_elo, l_elo, w_surface_elo, l_surface_elo: ratings before each match.

    Ratings of all players of a tour depend on one another in order, so a tour's matches are one ordered pass: they
    are dealt by tour, sorted there (with spill) and streamed; what is held is a rating per player and surface,
    never the matches. Tours that share no player run side by side.
    """
    rows = matches.select((tour if tour is not None else F.lit(0)).cast("string").alias("tour"), "tourney_date", "match_num", "w_sid", "l_sid", "surface")
    ordered = rows.repartition("tour").sortWithinPartitions("tour", *ORDER).select("tour", "match_num", "w_sid", "l_sid", "surface")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rating: dict[tuple, float] = {}
        played: dict[tuple, int] = {}
        for batch in batches:
            out: list[list[float]] = [[], [], [], []]
            for t, w, l, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):  # noqa: E741
                for at, kind in ((0, None), (2, s)):
                    a, b = (t, w, kind), (t, l, kind)
                    ra, rb = rating.get(a, INITIAL), rating.get(b, INITIAL)
                    out[at].append(ra)
                    out[at + 1].append(rb)
                    expected = 1.0 / (1.0 + 10 ** ((rb - ra) / 400.0))
                    na, nb = played.get(a, 0), played.get(b, 0)
                    rating[a], rating[b] = ra + k_factor(na) * (1 - expected), rb - k_factor(nb) * (1 - expected)
                    played[a], played[b] = na + 1, nb + 1
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.float64()) for x in out)], names=["match_num", "w_elo", "l_elo", "w_surface_elo", "l_surface_elo"])

    return ordered.mapInArrow(run, "match_num long, w_elo double, l_elo double, w_surface_elo double, l_surface_elo double")


def elo_features(ratings: DataFrame) -> DataFrame:
    """ratings with the winner's rating lead and win expectation, in general and on the surface."""
    p = lambda a, b: 1 / (1 + F.pow(F.lit(10.0), (F.col(b) - F.col(a)) / 400))
    return ratings.withColumns({"elo_diff": F.col("w_elo") - F.col("l_elo"), "elo_prob": p("w_elo", "l_elo"), "surface_elo_diff": F.col("w_surface_elo") - F.col("l_surface_elo"), "surface_elo_prob": p("w_surface_elo", "l_surface_elo")})
