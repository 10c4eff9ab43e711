"""Market prices: choice of a source, implied probabilities, benchmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SOURCES = ("odds_avg", "odds_b365")


def cascade(sources: Sequence[str] = SOURCES, averaged: Sequence[str] = ()) -> Column:
    """struct(w, l) of the first source with both prices; else the means of what ``averaged`` books offer."""
    pair = lambda w, l: F.when(w.isNotNull() & l.isNotNull(), F.struct(w.alias("w"), l.alias("l")))  # noqa: E731, E741
    options = [pair(F.col(f"{s}_w"), F.col(f"{s}_l")) for s in sources]
    if averaged:
        options.append(pair(row_mean([f"{s}_w" for s in averaged]), row_mean([f"{s}_l" for s in averaged])))
    return F.coalesce(*options)


def row_mean(columns: Sequence[str], places: int | None = None) -> Column:
    """Mean of a row's non-null values; null without any."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    n = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    mean = F.when(n > 0, total / n)
    return mean if places is None else F.round(mean, places)


def with_odds(matches: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """odds_w, odds_l, has_odds (both above 1) and winner_prob (inverse prices scaled to sum 1; 0.5 without)."""
    out = matches.withColumn("_o", cascade(sources)).withColumns({"odds_w": F.col("_o.w"), "odds_l": F.col("_o.l")}).drop("_o")
    has = F.coalesce((F.col("odds_w") > 1) & (F.col("odds_l") > 1), F.lit(False))
    return out.withColumn("has_odds", has.cast("int")).withColumn("winner_prob", F.when(has, (1 / F.col("odds_w")) / (1 / F.col("odds_w") + 1 / F.col("odds_l"))).otherwise(0.5))


def two_sided(priced: DataFrame) -> DataFrame:
    """Two rows per match: y = 1 from the winner's side with p1_price its implied probability, and the swapped one; price_diff between both sides."""
    row = lambda y, p: F.struct(F.lit(y).alias("y"), p.alias("p1_price"), (2 * p - 1).alias("price_diff"))
    return priced.select(*priced.columns, F.inline(F.array(row(1, F.col("winner_prob")), row(0, 1 - F.col("winner_prob")))))


def pooled(table: DataFrame, metrics: Sequence[str], n: str = "n") -> DataFrame:
    """Means of the metrics over a table's rows, each with weight n; n is the sum."""
    return table.agg(*[(F.sum(F.col(m) * F.col(n)) / F.sum(F.when(F.col(m).isNotNull(), F.col(n)))).alias(m) for m in metrics], F.sum(n).alias(n))


def attach(matches: DataFrame, prices: DataFrame) -> DataFrame:
    """matches with the price columns of the row of the same match_key (tournament and number); nulls without one, the first of repeated keys."""
    key = F.concat_ws("_", "tourney_id", "match_num")
    one = prices.groupBy("match_key").agg(F.min(F.struct(*[c for c in prices.columns if c != "match_key"])).alias("_p")).select("match_key", "_p.*")
    return matches.withColumn("match_key", key).join(one, "match_key", "left").drop("match_key")


def benchmark(priced: DataFrame, *by: str) -> DataFrame:
    """coverage, accuracy, brier, n of the market alone."""
    has = F.col("has_odds") == 1
    return priced.groupBy(*by).agg(F.avg("has_odds").alias("coverage"), F.avg(F.when(has, (F.col("winner_prob") > 0.5).cast("int"))).alias("accuracy"), F.avg(F.when(has, F.pow(1 - F.col("winner_prob"), 2))).alias("brier"), F.sum("has_odds").cast("long").alias("n"))


def overround(priced: DataFrame, *by: str) -> DataFrame:
    """Mean margin of a book over fair prices."""
    return priced.where("has_odds = 1").groupBy(*by).agg(F.avg(1 / F.col("odds_w") + 1 / F.col("odds_l") - 1).alias("overround"))
