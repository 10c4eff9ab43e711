"""Venue speed: ace rates of tournaments and surfaces, and the pace index with its fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from boutlog.functions.columns import tourney_base
from boutlog.session import stored

SUPPORT, STD_DEFAULT = 20, 0.02


def _played(matches: DataFrame) -> DataFrame:
    base = matches.select(tourney_base(F.col("tourney_id")).alias("base"), "surface", (F.col("w_ace") + F.col("l_ace")).alias("ace"), (F.col("w_svpt") + F.col("l_svpt")).alias("svpt"))
    return base.where("svpt > 0")


def pace_by_tourney(matches: DataFrame, support: int = SUPPORT) -> DataFrame:
    """base, surface, pace, n of tournaments with enough matches; null keys form no group."""
    rows = _played(matches).where("base IS NOT NULL AND surface IS NOT NULL")
    return rows.groupBy("base", "surface").agg((F.sum("ace") / F.sum("svpt")).alias("pace"), F.count("*").alias("n")).where(F.col("n") >= support)


def pace_by_surface(matches: DataFrame) -> DataFrame:
    return _played(matches).where("surface IS NOT NULL").groupBy("surface").agg((F.sum("ace") / F.sum("svpt")).alias("pace"))


def pace_scale(matches: DataFrame, support: int = SUPPORT) -> DataFrame:
    """One row: mean (ratio of sums) and std (of supported tournaments; STD_DEFAULT where it is undefined or zero)."""
    mean = _played(matches).agg((F.sum("ace") / F.sum("svpt")).alias("mean"))
    std = F.stddev_samp("pace")
    return mean.crossJoin(F.broadcast(pace_by_tourney(matches, support).agg(F.when(std > 0, std).otherwise(STD_DEFAULT).alias("std"))))


def with_pace(matches: DataFrame, history: DataFrame, support: int = SUPPORT) -> DataFrame:
    """matches with court_pace: (pace - mean) / std, by tournament, else surface, else 0.

    The history is read once, for the sums of each venue and surface; tournaments', surfaces' and the scale's figures are sums of those.
    """
    sums = stored(_played(history).groupBy("base", "surface").agg(F.sum("ace").alias("ace"), F.sum("svpt").alias("svpt"), F.count("*").alias("n")))
    tourneys = sums.where((F.col("n") >= support) & F.col("base").isNotNull() & F.col("surface").isNotNull()).select("base", "surface", (F.col("ace") / F.col("svpt")).alias("_t"))
    surfaces = sums.where("surface IS NOT NULL").groupBy("surface").agg((F.sum("ace") / F.sum("svpt")).alias("_s"))
    std = F.stddev_samp("_t")
    scale = sums.agg((F.sum("ace") / F.sum("svpt")).alias("mean")).crossJoin(F.broadcast(tourneys.agg(F.when(std > 0, std).otherwise(STD_DEFAULT).alias("std"))))
    # a stored table's size is known, so Spark broadcasts it under its own threshold and else shuffles
    out = matches.withColumn("base", tourney_base(F.col("tourney_id"))).join(tourneys, ["base", "surface"], "left").join(surfaces, "surface", "left").crossJoin(F.broadcast(scale))
    return out.withColumn("court_pace", (F.coalesce("_t", "_s", "mean") - F.col("mean")) / F.col("std")).drop("base", "_t", "_s", "mean", "std")


def pace_before(matches: DataFrame, support: int = SUPPORT) -> DataFrame:
    """season, base, surface, court_pace: the pace index of each venue from the seasons before, for every season that the log has.

    One aggregate of the log, by venue and season; what follows are running sums over that small table. A venue without enough
    earlier matches has its surface's pace, else the mean (0); in the first season there is no pace at all (null).
    """
    sums = matches.withColumn("base", tourney_base(F.col("tourney_id"))).where("base IS NOT NULL AND surface IS NOT NULL")
    played = F.col("w_svpt") + F.col("l_svpt") > 0
    sums = sums.groupBy("base", "surface", "season").agg(F.sum(F.when(played, F.col("w_ace") + F.col("l_ace"))).alias("ace"), F.sum(F.when(played, F.col("w_svpt") + F.col("l_svpt"))).alias("svpt"), F.count_if(played).alias("n"))
    seasons = sums.agg(F.sort_array(F.collect_set("season")).alias("all")).select(F.explode("all").alias("season"))  # a row per season
    every = sums.select("base", "surface").distinct().crossJoin(F.broadcast(seasons))
    held = every.join(sums, ["base", "surface", "season"], "left")
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    venues = held.select("base", "surface", "season", *[F.coalesce(F.sum(c).over(so_far("base", "surface")), F.lit(0)).alias(c) for c in ("ace", "svpt", "n")])
    surfaces = venues.groupBy("surface", "season").agg(F.try_divide(F.sum("ace"), F.sum("svpt")).alias("_s"))
    supported = F.when((F.col("n") >= support) & (F.col("svpt") > 0), F.col("ace") / F.col("svpt"))
    std = F.stddev_samp(supported)
    scale = venues.groupBy("season").agg(F.try_divide(F.sum("ace"), F.sum("svpt")).alias("mean"), F.when(std > 0, std).otherwise(STD_DEFAULT).alias("std"))
    paced = venues.withColumn("_t", supported).join(surfaces, ["surface", "season"]).join(scale, "season")
    return paced.select("season", "base", "surface", ((F.coalesce("_t", "_s", "mean") - F.col("mean")) / F.col("std")).alias("court_pace"))


def with_pace_before(matches: DataFrame, support: int = SUPPORT) -> DataFrame:
    """matches with court_pace from earlier seasons only; 0 where there is none."""
    keyed = matches.withColumn("base", tourney_base(F.col("tourney_id")))
    return keyed.join(pace_before(matches, support), ["season", "base", "surface"], "left").withColumn("court_pace", F.coalesce("court_pace", F.lit(0.0))).drop("base")
