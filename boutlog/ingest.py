"""Queries of what comes in from outside: feed files whose columns drift, and an incrementally merged table.

Files and micro-batches are made by Spark from the match log in the shared folder and read back, so the work grows with the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from boutlog.operators import market_feed
from boutlog.registry import register
from boutlog.session import discard, shared_folder, stored
from boutlog.sources.feeds import read_feed
from boutlog.streaming import upserts

LEGACY = 1995  # seasons before it are written with the older names and formats
_BOOKS = {"EnglishAvg": "odds_avg", "B365": "odds_b365"}
#: Prices of more books, from those of the log: book -> (price column, added, remainder of match_num by 5 without one).
_MORE = {"PS": ("odds_b365", 0.1, 1), "STS": ("odds_avg", 0.05, 2), "Fortuna": ("odds_b365", 0.15, 3)}


def priced(m: DataFrame) -> DataFrame:
    """The log as feed rows: keys, and prices of the books."""
    books = [F.col(f"{c}_{side[0]}").alias(f"{b}_{side}") for b, c in _BOOKS.items() for side in ("winner", "loser")]
    more = [F.when(F.col("match_num") % 5 != r, F.col(f"{c}_{side[0]}") + add).alias(f"{b}_{side}") for b, (c, add, r) in _MORE.items() for side in ("winner", "loser")]
    return m.select("season", F.concat_ws("_", "tourney_id", "match_num").alias("match_key"), "tourney_id", "match_num", "tourney_date", *books, *more)


def write_feed(m: DataFrame, folder: str) -> None:
    """A folder of delimited files per season: older seasons with older names, maxima, ``.0`` integers and compact dates."""
    rows = priced(m)
    old = rows.where(F.col("season") < LEGACY).withColumns({"match_num": F.concat(F.col("match_num").cast("string"), F.lit(".0")), "tourney_date": F.date_format("tourney_date", "yyyyMMdd"), "Max_winner": F.lit(9.9), "Max_loser": F.lit(9.9)})
    old = old.withColumnsRenamed({new: legacy for legacy, new in market_feed.RENAMED.items()}).drop(*[f"{b}_{side}" for b in _MORE for side in ("winner", "loser")])
    new = rows.where(F.col("season") >= LEGACY).select("season", "tourney_date", *[c for c in reversed(rows.columns) if c not in ("season", "tourney_date")])
    for part in (old, new):
        part.repartition("season").write.mode("append").partitionBy("season").option("header", True).csv(folder)


def odds_feed(m: DataFrame) -> DataFrame:
    """The feed written, and read again in one scan of all its files."""
    folder = f"{shared_folder(m.sparkSession)}/feed-{uuid.uuid4().hex}"
    write_feed(m, folder)
    return read_feed(m.sparkSession, [folder], market_feed.ODDS_FEED)


_feed_sql = """fd AS (SELECT season, tourney_id || '_' || match_num AS match_key, tourney_id, match_num, tourney_date, odds_avg_w AS EnglishAvg_winner, odds_avg_l AS EnglishAvg_loser, odds_b365_w AS B365_winner, odds_b365_l AS B365_loser, """ + ", ".join(
    f"CASE WHEN season >= {LEGACY} AND match_num % 5 <> {r} THEN {c}_{side[0]} + {add}::DOUBLE END AS {b}_{side}" for b, (c, add, r) in _MORE.items() for side in ("winner", "loser")
) + " FROM matches)"


def _mean_sql(books: list[str], side: str) -> str:
    names = [f"{b}_{side}" for b in books]
    n = " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in names)
    return f"CASE WHEN {n} > 0 THEN floor(round(({' + '.join(f'coalesce({x}, 0)' for x in names)}) / ({n}) * 100, 6) + 0.5) / 100 END"


_PRICES = [f"{b}_{side}" for b in (*_BOOKS, *_MORE) for side in ("winner", "loser")]
_MEANS = {f"{name}_{side}": _mean_sql(books, side) for side in ("winner", "loser") for name, books in (("PolishAvg", ["Fortuna", "STS"]), ("AllAvg", ["B365", "PS", "Fortuna", "STS"]))}
_r = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"
register(
    "odds_feed",
    lambda m: market_feed.with_averages(odds_feed(m)).select("match_key", F.col("season").cast("long").alias("season"), "tourney_id", F.col("match_num").cast("long").alias("match_num"), "tourney_date", *_PRICES, *_MEANS),
    f"SELECT match_key, season, tourney_id, match_num, tourney_date, {', '.join(_r(c, c) for c in _PRICES)}, {', '.join(_r(e, n) for n, e in _MEANS.items())} FROM fd",
    _feed_sql,
)


def _five(side: str) -> str:
    mean = "CASE WHEN (Fortuna_{0} IS NOT NULL OR STS_{0} IS NOT NULL) THEN (coalesce(Fortuna_{0}, 0) + coalesce(STS_{0}, 0)) / (CAST(Fortuna_{0} IS NOT NULL AS INT) + CAST(STS_{0} IS NOT NULL AS INT)) END"
    some = lambda x: f"(Fortuna_{x} IS NOT NULL OR STS_{x} IS NOT NULL)"
    cases = " ".join(f"WHEN {b}_winner IS NOT NULL AND {b}_loser IS NOT NULL THEN {b}_{side}" for b in ("EnglishAvg", "PS", "B365"))
    return f"CASE {cases} WHEN {some('winner')} AND {some('loser')} THEN {mean.format(side)} END"


register(
    "odds_cascade_five",
    lambda m: market_feed.pairs(odds_feed(m)),
    f"SELECT match_key, {_r(_five('winner'), 'odds_w')}, {_r(_five('loser'), 'odds_l')} FROM fd",
    _feed_sql,
)


def _recomputed(m: DataFrame) -> DataFrame:
    """A feed that has its outside matches already: averages anew, and each outside match at its first row only."""
    feed = priced(m).withColumn("be_match_id", F.when(F.col("match_num") % 4 != 0, F.concat(F.lit("b"), F.floor(F.col("match_num") / 5).cast("string"))))
    return market_feed.with_averages(market_feed.one_use(feed)).select("match_key", "be_match_id", *_MEANS)


register(
    "recomputed_averages",
    _recomputed,
    f"SELECT match_key, CASE WHEN id IS NOT NULL AND row_number() OVER (PARTITION BY id ORDER BY tourney_date, match_num) = 1 THEN id END AS be_match_id, {', '.join(_r(e, n) for n, e in _MEANS.items())} FROM (SELECT *, CASE WHEN match_num % 4 <> 0 THEN 'b' || (match_num // 5) END AS id FROM fd)",
    _feed_sql,
)

# --- an incremental table

SLICES = 3
_ADDED = (0.0, 0.25, 0.5)  # prices of a later slice differ, so that what is kept of a match shows where it came from


def _slice(prices: DataFrame, k: int) -> DataFrame:
    """Rows of the k-th delivery: two thirds of the log, a fifth of them twice; the local books come with later ones."""
    rows = prices.where((F.col("match_num") % SLICES == k) | (F.col("match_num") % 2 == k % 2))
    moved = rows.withColumns({c: F.col(c) + _ADDED[k] for c in rows.columns[3:]})
    moved = moved.drop("STS_winner", "STS_loser") if k == 0 else moved
    first = F.struct(F.col("B365_winner"), F.lit(1).alias("arrived"))
    again = F.when(F.col("match_num") % 5 == 0, F.array(first, F.struct(F.lit(99.0).alias("B365_winner"), F.lit(2).alias("arrived")))).otherwise(F.array(first))
    return moved.select(*[c for c in moved.columns if c != "B365_winner"], F.inline(again)).select(*moved.columns, "arrived")


def incremental_upsert(m: DataFrame) -> DataFrame:
    """The table after three deliveries, each a run of the stream over what is new, the last one delivered twice.

    Deliveries are made from prices that are stored once, not from the log anew.
    """
    spark = m.sparkSession
    prices = stored(priced(m).select("season", "match_key", "match_num", "B365_winner", "B365_loser", "STS_winner", "STS_loser"))
    home = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    schema = _slice(prices, 1).schema
    for k in (*range(SLICES), SLICES - 1):
        _slice(prices, k).write.mode("append").parquet(f"{home}/feed")
        upserts.upsert_stream(spark.readStream.schema(schema).parquet(f"{home}/feed"), f"{home}/table", f"{home}/checkpoint", "match_key", "season", "arrived", market_feed.with_averages)
    discard(prices)
    table = upserts.read_table(spark, f"{home}/table")
    return table.select(F.col("season").cast("long").alias("season"), "match_key", "match_num", *_UPSERTED)


_UPSERTED = ["B365_winner", "B365_loser", "STS_winner", "STS_loser", *market_feed.DERIVED]


def _first_price(column: str, log: str, books: tuple[int, ...]) -> str:
    """The price of the first delivery that has the match and a price; a second row of a delivery fills what its first leaves open."""
    options = []
    for k in books:
        held = f"(match_num % {SLICES} = {k} OR match_num % 2 = {k % 2})"
        again = f", CASE WHEN {held} AND match_num % 5 = 0 THEN 99.0::DOUBLE END" if column == "B365_winner" else ""
        options.append(f"CASE WHEN {held} THEN {log} + {_ADDED[k]}::DOUBLE END{again}")
    return f"coalesce({', '.join(options)}) AS {column}"


_upsert_sql = f"""up AS (SELECT season, match_key, match_num, {_first_price('B365_winner', 'B365_winner', (0, 1, 2))}, {_first_price('B365_loser', 'B365_loser', (0, 1, 2))}, {_first_price('STS_winner', 'STS_w', (1, 2))}, {_first_price('STS_loser', 'STS_l', (1, 2))}
  FROM (SELECT season, tourney_id || '_' || match_num AS match_key, match_num, odds_b365_w AS B365_winner, odds_b365_l AS B365_loser, CASE WHEN match_num % 5 <> 2 THEN odds_avg_w + 0.05::DOUBLE END AS STS_w, CASE WHEN match_num % 5 <> 2 THEN odds_avg_l + 0.05::DOUBLE END AS STS_l FROM matches))"""
register(
    "incremental_upsert",
    incremental_upsert,
    f"SELECT season, match_key, match_num, {', '.join(_r(c, c) for c in _UPSERTED[:4])}, {', '.join(_r(_mean_sql(books, side), f'{name}_{side}') for side in ('winner', 'loser') for name, books in (('PolishAvg', ['STS']), ('AllAvg', ['B365', 'STS'])))} FROM up",
    _upsert_sql,
)
