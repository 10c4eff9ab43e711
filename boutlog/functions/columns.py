"""Column functions of the domain: bins, labels, encodings, intervals. All are built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The codes that trained models and published tables rely on.
SURFACE_CODES = {"Carpet": 0, "Clay": 1, "Grass": 2, "Hard": 3}
LEVEL_CODES = {"250": 0, "500": 1, "A": 2, "D": 3, "F": 4, "G": 5, "M": 6, "O": 7}
ROUND_CODES = {"R128": 1, "R64": 2, "R32": 3, "RR": 3, "ER": 3, "R16": 4, "QF": 5, "SF": 6, "BR": 6, "3rd/4th": 6, "F": 7}
UNKNOWN_CODE, ROUND_UNKNOWN = -1, 3
LEVEL_STRENGTH = {"G": 1.00, "M": 0.92, "F": 0.88, "A": 0.84, "500": 0.78, "250": 0.68, "D": 0.58, "O": 0.50}
LEVEL_STRENGTH_UNKNOWN = 0.60
RANK_GAPS = ((10, "0-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (None, ">100"))
AGE_GAPS = ((2, "0-2"), (5, "3-5"), (8, "6-8"), (None, ">8"))
FORM_GAPS = ((0.10, "0.00-0.10"), (0.25, "0.10-0.25"), (0.40, "0.25-0.40"), (None, ">0.40"))
#: Priors of the serve and return shares.
SERVE_PRIORS = {"ace_rate": 0.08, "df_rate": 0.03, "first_in_pct": 0.60, "first_won_pct": 0.70, "second_won_pct": 0.50, "bp_save_pct": 0.60, "bp_faced_per_game": 0.40, "return_pts_won": 0.35}

#: Numerator and denominator of each share, over a player view's columns.
SHARES = {
    "ace_rate": ("ace", "svpt"),
    "df_rate": ("df", "svpt"),
    "first_in_pct": ("first_in", "svpt"),
    "first_won_pct": ("first_won", "first_in"),
    "second_won_pct": ("second_won", "(svpt - first_in)"),
    "bp_save_pct": ("bp_saved", "bp_faced"),
    "bp_faced_per_game": ("bp_faced", "sv_gms"),
    "return_pts_won": ("(o_svpt - o_first_won - o_second_won)", "o_svpt"),
}


def share_sql(name: str) -> str:
    """A share, null where its denominator is not positive."""
    a, b = SHARES[name]
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def encoded(column: Column, codes: Mapping[str, int], unknown: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[column], F.lit(unknown))


def binned(x: Column, bins: Sequence[tuple[float | None, str]]) -> Column:
    """The label of the first bin whose upper edge is at least x (right-closed)."""
    out = F.lit(bins[-1][1])
    for edge, label in reversed(bins[:-1]):
        out = F.when(x <= F.lit(float(edge)), label).otherwise(out)
    return F.when(x.isNotNull(), out)


def binned_sql(x: str, bins: Sequence[tuple[float | None, str]]) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} <= cast({e} as double) THEN '{label}'" for e, label in bins[:-1]) + f" ELSE '{bins[-1][1]}' END"


def sorted_pair(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("-vs-"), F.greatest(a, b))


def tourney_base(tourney_id: Column) -> Column:
    """A tournament's key without the year."""
    return F.regexp_replace(tourney_id, r"^\d{4}-", "")


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.when(b > 0, a / b)
    return out if default is None else out.otherwise(F.lit(default))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share; (0, 1) without rows."""
    p = successes / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    high = (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), high)).otherwise(1.0)


def half_width(p: Column, n: Column, z: float = 1.96) -> Column:
    """Half of the normal interval of a share."""
    return F.when(n > 0, z * F.sqrt(p * (1 - p) / n)).otherwise(0.0)


def mcnemar_z(b: Column, c: Column) -> Column:
    """The corrected statistic of paired outcomes; 0 without discordant pairs."""
    return F.when(b + c > 0, F.greatest(F.abs(b - c) - 1, F.lit(0)) / F.sqrt(F.greatest((b + c).cast("double"), F.lit(1.0)))).otherwise(0.0)


#: Coefficients of the Chebyshev fit of the complementary error function (relative error below 1.2e-7), lowest power first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """erfc(|z| / sqrt 2), as column arithmetic."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    inner = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        inner = inner * t + c
    return F.least(F.lit(1.0), t * F.exp(inner - x * x))


def two_sided_p_sql(z: str) -> str:
    t = f"(1 / (1 + 0.5::DOUBLE * (abs({z}) / {math.sqrt(2)!r}::DOUBLE)))"
    inner = f"{ERFC[-1]}::DOUBLE"
    for c in reversed(ERFC[:-1]):
        inner = f"({inner} * {t} + {c}::DOUBLE)"
    return f"least(1, {t} * exp({inner} - ({z}) * ({z}) / 2))"


def seed_slots(draw: Column) -> Column:
    return F.when(draw.isNull(), 8).when(draw >= 96, 32).when(draw >= 56, 16).when(draw >= 28, 8).otherwise(4)


def seed_context(seed: Column, rank: Column, draw: Column) -> Column:
    """1 for the first seed down to 0; unseeded players by a proxy of their rank."""
    slots = seed_slots(draw).cast("double")
    soft = (slots + 2 - rank) / (slots + 2)
    return F.when(seed.isNotNull(), F.greatest(F.lit(0.0), 1 - (seed - 1) / slots)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), soft)))


#: Weight, and the unit and cap of shares that are scaled first.
SERVE_SCORE = {"ace_rate": (0.10, 0.15), "first_in_pct": (0.18, None), "first_won_pct": (0.24, None), "second_won_pct": (0.22, None), "bp_save_pct": (0.14, None), "return_pts_won": (0.12, None), "df_rate": (-0.08, 0.08), "bp_faced_per_game": (-0.08, 0.80)}
SERVE_SCORE_CAP = 1.5


def serve_score_sql(prefix: str = "", substitute: bool = False) -> str:
    """The composite serve score as SQL; substitute: priors for null shares."""
    terms = []
    for name, (weight, unit) in SERVE_SCORE.items():
        x = f"{prefix}{name}"
        x = f"coalesce({x}, {SERVE_PRIORS[name]}D)" if substitute else x
        terms.append(f"{weight}D * " + (f"least({x} / {unit}D, {SERVE_SCORE_CAP}D)" if unit else x))
    return " + ".join(terms)


def without_last_bits(x: Column, places: int) -> Column:
    """x rounded to places, where only its last bits matter: not by decimal numbers as round() is, as long as a long holds x in units of the last place."""
    unit = 10**places
    return F.when(F.abs(x) < 1e18 / (100 * unit), F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit).otherwise(F.round(x, places))
