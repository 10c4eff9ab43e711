"""From matches to a balanced two-perspective sample, splits, encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.functions.columns import LEVEL_CODES, LEVEL_STRENGTH, LEVEL_STRENGTH_UNKNOWN, ROUND_CODES, ROUND_UNKNOWN, SHARES, SURFACE_CODES, UNKNOWN_CODE, encoded
from boutlog.operators.ordering import numbered

SMALL = ("rank_log", "points_log", "age", "ht", "is_lefty", "form", "surface_form")


def encode(df: DataFrame) -> DataFrame:
    """surface_code, level_code, round_code by the fixed dictionaries."""
    return df.withColumns({"surface_code": encoded(F.col("surface"), SURFACE_CODES, UNKNOWN_CODE), "level_code": encoded(F.col("level"), LEVEL_CODES, UNKNOWN_CODE), "round_code": encoded(F.col("round"), ROUND_CODES, ROUND_UNKNOWN)})


def unknown_categories(df: DataFrame) -> DataFrame:
    """column_name, value, n of values outside the dictionaries; one pass over the rows."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), (~F.col(c).isin(*codes)).alias("odd")) for c, codes in (("surface", SURFACE_CODES), ("level", LEVEL_CODES), ("round", ROUND_CODES))]
    return df.select(F.inline(F.array(*pairs))).where("odd").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def fitted_codes(train: DataFrame, column: str) -> DataFrame:
    """value, code (0-based by value) of the values seen in training: distinct values are numbered by ranges, not in one task."""
    seen = train.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return numbered(seen, ["value"], "code")


def apply_codes(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """df with the code of the column's value as ``name``; null and values not seen in training get the first one's.

    A small dictionary is broadcast by Spark's own size threshold; with a larger one a frequent value is split by adaptive execution.
    """
    return df.join(codes.select(F.col("value").alias(column), F.col("code").alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def static_features(df: DataFrame) -> DataFrame:
    """Logs of rank and points, lefty flags and the round's order."""
    out = {}
    for x in "wl":
        out |= {f"{x}_rank_log": F.ln(F.col(f"{x}_rank")), f"{x}_points_log": F.ln(F.col(f"{x}_points")), f"{x}_is_lefty": F.coalesce((F.col(f"{x}_hand") == "L").cast("int"), F.lit(0))}
    return encode(df.withColumns(out))


def placed_in_time(matches: DataFrame) -> DataFrame:
    """matches with _at, their 0-based place by day and match_num, and _all, how many there are.

    Places come from counts per day, so no global sort meets in one task: a day's rows are numbered where the day
    is, and days' totals (one row each) are summed up.
    """
    days = matches.groupBy("tourney_date").agg(F.count("*").alias("n"))
    totals = days.withColumn("_before", F.sum("n").over(Window.orderBy("tourney_date")) - F.col("n")).crossJoin(F.broadcast(days.agg(F.sum("n").alias("_all"))))
    placed = matches.withColumn("_in", F.row_number().over(Window.partitionBy("tourney_date").orderBy("match_num")) - 1).join(totals.drop("n"), "tourney_date")
    return placed.withColumn("_at", F.col("_before") + F.col("_in")).drop("_in", "_before")


def chrono_split(matches: DataFrame, parts: Sequence[float] = (0.6, 0.8)) -> DataFrame:
    """split (train, val, test) and match_id (0-based within it) by place in time."""
    at = F.col("_at")
    a, b = (F.floor(F.col("_all") * p) for p in parts)
    first = F.when(at < a, F.lit(0)).when(at < b, a).otherwise(b)
    return placed_in_time(matches).withColumns({"split": F.when(at < a, "train").when(at < b, "val").otherwise("test"), "match_id": (at - first).cast("long")}).drop("_at", "_all")


def expanding_folds(matches: DataFrame, folds: int = 5) -> DataFrame:
    """matches with fold: 1 to ``folds`` for the last parts in time, each a (folds + 1)th of all matches, rounded down; 0 for those before.

    Fold k is tested on its own matches, trained on all of lower folds. Under folds + 1 matches there is fold 0 alone.
    """
    size = F.floor(F.col("_all") / (folds + 1))
    begin = F.col("_all") - folds * size
    fold = F.when((size == 0) | (F.col("_at") < begin), 0).otherwise(F.floor(F.try_divide(F.col("_at") - begin, size)) + 1)
    return placed_in_time(matches).withColumn("fold", fold.cast("int")).drop("_at", "_all")


def season_split(df: DataFrame, validation: int, test: int) -> DataFrame:
    return df.withColumn("split", F.when(F.col("season") < validation, "train").when(F.col("season") == validation, "val").when(F.col("season") == test, "test"))


def both_sides(view: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """match_num, carry, and w_<c>, l_<c> of a player view: one group per match instead of a self-join.

    Rows are dealt by match first, as sides of a match rarely meet before: so they are sorted once, not before and after the shuffle.
    """
    agg = [F.max(F.when(F.col("side") == x, F.struct(*[F.col(c) for c in columns]))).alias(x) for x in "wl"]
    wide = view.repartition("match_num").groupBy("match_num").agg(*agg, *[F.first(c).alias(c) for c in carry])
    return wide.select("match_num", *carry, *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "wl" for c in columns])


def symmetrize(wide: DataFrame, names: Sequence[str], differences: Sequence[str] = (), negated: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Two rows per match: p1_, p2_ and <n>_diff columns with roles swapped, y = 1 where p1 won; ``negated`` columns change sign."""

    def row(a: str, b: str, y: int) -> Column:
        s = 1 if y else -1
        return F.struct(
            F.lit(y).alias("y"),
            *[F.col(f"{x}_{n}").alias(f"p{i}_{n}") for n in names for i, x in ((1, a), (2, b))],
            *[(F.col(f"{a}_{n}") - F.col(f"{b}_{n}")).alias(f"{n}_diff") for n in differences],
            *[(F.col(c) * s).alias(f"p1_{c}") for c in negated],
        )

    keep = ["match_num", *carry]
    return wide.select(*keep, F.inline(F.array(row("w", "l", 1), row("l", "w", 0))))


def lefty_flags(df: DataFrame) -> DataFrame:
    """one_lefty (exactly one of the two), is_bo5, is_qf, pressure (level strength in best-of-five)."""
    strength = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVEL_STRENGTH.items() for x in kv])[F.col("level")], F.lit(LEVEL_STRENGTH_UNKNOWN))
    one = (F.col("w_hand") == "L") != (F.col("l_hand") == "L")
    return df.withColumns({"one_lefty": one.cast("int"), "is_bo5": (F.col("best_of") == 5).cast("int"), "is_qf": (F.col("round") == "QF").cast("int"), "pressure": strength * (F.col("best_of") == 5).cast("int")})


def sample(features: DataFrame, extra: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """The two-perspective sample of a feature view: baseline features, ``extra`` columns with their differences, and ``flags``, which are the match's."""
    view = encode(features).withColumns({"rank_log": F.ln("rank"), "points_log": F.ln("points"), "is_lefty": F.coalesce((F.col("hand") == "L").cast("int"), F.lit(0))})
    shares = [f"avg_{s}" for s in SHARES]
    carry = ["season", "tourney_date", "surface_code", "level_code", "best_of", "round_code", *flags]
    wide = both_sides(view, ["player", "h2h", *SMALL, *shares, *extra], carry).withColumn("h2h", F.col("w_h2h"))
    return symmetrize(wide, ["player", *SMALL, *shares, *extra], ["rank_log", "points_log", "age", "ht", "form", *extra], ["h2h"], carry)
