"""The market feed's columns: books, older names, averages over books, and the price of a match from the best source there is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.functions.columns import without_last_bits
from boutlog.operators.odds import cascade
from boutlog.sources.feeds import Feed

# Columns of the feed's files, as published.
LOCAL_BOOKS = ("Betclic", "BETFAN", "Fortuna", "Fuksiarz", "LVBET", "STS", "Superbet")
SINGLE_BOOKS = ("B365", "PS", *LOCAL_BOOKS)
RENAMED = {"Avg_winner": "EnglishAvg_winner", "Avg_loser": "EnglishAvg_loser"}
#: Sources of a match's price in falling order; the local books' mean comes after them.
PRIORITY = ("EnglishAvg", "Avg", "PS", "B365")
DERIVED = tuple(f"{a}_{side}" for side in ("winner", "loser") for a in ("PolishAvg", "AllAvg"))

_KINDS = {"match_key": "string", "tourney_id": "string", "match_num": "int", "tourney_date": "date", "winner_name": "string", "loser_name": "string", "td_date": "date", "rank_agreement": "int", "be_match_id": "string"}
#: What is read of a feed file: the maxima of older files are left out, as are derived columns, which are computed anew.
ODDS_FEED = Feed(_KINDS | {f"{b}_{side}": "double" for b in ("EnglishAvg", *SINGLE_BOOKS) for side in ("winner", "loser")}, "match_key", RENAMED)


def rounded_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-null values to two places, halves up; null without any."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return F.when(n > 0, F.floor(without_last_bits(total / n * 100, 6) + 0.5) / 100)


def with_averages(feed: DataFrame) -> DataFrame:
    """feed with the means over local books and over all single books, of those columns that it has."""
    out = {}
    for side in ("winner", "loser"):
        for name, books in (("PolishAvg", LOCAL_BOOKS), ("AllAvg", SINGLE_BOOKS)):
            have = [F.col(f"{b}_{side}") for b in books if f"{b}_{side}" in feed.columns]
            out[f"{name}_{side}"] = rounded_mean(have) if have else F.lit(None).cast("double")
    return feed.withColumns(out)


def one_use(feed: DataFrame, identity: str = "be_match_id", order: Sequence[str] = ("tourney_date", "match_num")) -> DataFrame:
    """feed, where an outside match stands at its first row (by order) only: the identity of later rows is cleared."""
    first = F.row_number().over(Window.partitionBy(identity).orderBy(*order)) == 1
    named = feed.where(F.col(identity).isNotNull()).withColumn(identity, F.when(first, F.col(identity)))
    return named.unionByName(feed.where(F.col(identity).isNull()))


def pairs(feed: DataFrame) -> DataFrame:
    """match_key, odds_w, odds_l: both prices of the first source that has both, else the local books' means; null without."""
    have = lambda b: f"{b}_winner" in feed.columns and f"{b}_loser" in feed.columns
    named = feed.select("match_key", *[F.col(f"{b}_{side}").alias(f"{b}_{side[0]}") for b in dict.fromkeys((*PRIORITY, *LOCAL_BOOKS)) if have(b) for side in ("winner", "loser")])
    chosen = cascade([b for b in PRIORITY if have(b)], [b for b in LOCAL_BOOKS if have(b)])
    return named.select("match_key", chosen.alias("_o")).select("match_key", F.col("_o.w").alias("odds_w"), F.col("_o.l").alias("odds_l"))
