"""The match log: one row per finished match, derived from ``lineitem`` and ``orders``, or read from season files.

The first two lines of an order (by a total order of its lines) are the two players; the one of the larger
price won. Column texts are SQL that Spark and DuckDB read alike, so queries and their oracles share one
definition of the data and differ in everything computed from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from boutlog.sources.feeds import Feed, read_years

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
SERVE = ("svpt", "ace", "df", "first_in", "first_won", "second_won", "sv_gms", "bp_saved", "bp_faced")


def _d(number: str) -> str:
    return f"cast({number} as double)"


def _side(x: str) -> dict[str, str]:
    s, p, q, none = f"{x}s", f"{x}p", f"{x}q", f"mod({x}p, 97) = 0"
    first_in = f"({q} + 25 - mod({p}, 20))"
    return {
        f"{x}_sid": s,
        f"{x}_svpt": _d(f"CASE WHEN {none} THEN 0 ELSE {q} + 30 END"),
        f"{x}_ace": _d(f"mod({p}, 12)"),
        f"{x}_df": _d(f"mod({p}, 7)"),
        f"{x}_first_in": _d(f"CASE WHEN {none} THEN 0 ELSE {first_in} END"),
        f"{x}_first_won": _d(f"CASE WHEN {none} THEN 0 ELSE {first_in} - mod({p}, 6) END"),
        f"{x}_second_won": _d(f"CASE WHEN {none} THEN 0 ELSE 5 + mod({p}, 20) - mod({p}, 4) END"),
        f"{x}_sv_gms": _d(f"8 + mod({p}, 7)"),
        f"{x}_bp_faced": _d(f"mod({p}, 5)"),
        f"{x}_bp_saved": _d(f"CASE WHEN mod({p}, 5) = 0 THEN 0 ELSE mod({s}, mod({p}, 5) + 1) END"),
        f"{x}_rank": f"1 + mod(37 * {s} + ok, 150)",
        f"{x}_points": f"1 + mod(53 * {s} + ok, 5000)",
        f"{x}_age": f"18 + {_d(f'mod(11 * {s}, 200)')} / 10",
        f"{x}_ht": f"170 + mod({s}, 35)",
        f"{x}_hand": f"CASE WHEN mod({s}, 7) = 0 THEN 'L' WHEN mod({s}, 31) = 0 THEN 'U' ELSE 'R' END",
        f"{x}_seed": f"CASE WHEN 1 + mod(37 * {s} + ok, 150) <= 32 THEN 1 + mod(37 * {s} + ok, 150) END",
    }


COLUMNS: dict[str, str] = {
    "season": "cast(year(od) as bigint)",
    "tourney_date": "cast(date_trunc('month', od) as date)",
    "match_num": "ok",
    "tourney_id": "concat(cast(year(od) as string), '-', cast(month(od) as string), 'P', d1)",
    "surface": "CASE d1 WHEN '2' THEN 'Clay' WHEN '3' THEN 'Grass' WHEN '4' THEN 'Carpet' ELSE 'Hard' END",
    "level": "CASE WHEN month(od) IN (1, 5, 7, 9) THEN 'G' WHEN month(od) IN (3, 8) THEN 'M' WHEN month(od) = 11 THEN 'F' WHEN month(od) = 2 THEN 'D' ELSE '250' END",
    "best_of": "CASE WHEN month(od) IN (1, 5, 7, 9) THEN cast(5 as bigint) ELSE cast(3 as bigint) END",
    "round": "CASE mod(ok, 7) WHEN 0 THEN 'R128' WHEN 1 THEN 'R64' WHEN 2 THEN 'R32' WHEN 3 THEN 'R16' WHEN 4 THEN 'QF' WHEN 5 THEN 'SF' ELSE 'F' END",
    "minutes": f"CASE WHEN mod(ok, 13) = 0 THEN NULL ELSE {_d('60 + mod(ok, 180)')} END",
    "draw_size": "CASE WHEN month(od) IN (1, 5, 7, 9) THEN cast(128 as bigint) WHEN month(od) IN (3, 8) THEN cast(64 as bigint) ELSE cast(32 as bigint) END",
    **_side("w"),
    **_side("l"),
    "odds_avg_w": f"CASE WHEN mod(ok, 10) = 0 THEN NULL ELSE {_d('1.05')} + {_d('mod(7 * wp + ok, 300)')} / 100 END",
    "odds_avg_l": f"CASE WHEN mod(ok, 10) = 0 THEN NULL ELSE {_d('1.05')} + {_d('mod(7 * lp + ok, 300)')} / 100 END",
    "odds_b365_w": f"CASE WHEN mod(ok, 4) = 0 THEN NULL ELSE {_d('1.05')} + {_d('mod(3 * wp + ok, 280)')} / 100 END",
    "odds_b365_l": f"CASE WHEN mod(ok, 6) = 0 THEN NULL ELSE {_d('1.05')} + {_d('mod(3 * lp + ok, 280)')} / 100 END",
}


def match_log(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """COLUMNS of every order whose first two lines have different players. One shuffle of each table, on the order key."""
    line = lineitem.select("l_orderkey", *LINE_ORDER)
    top = line.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))).where("rn <= 2")
    of = lambda n: F.max(F.when(F.col("rn") == n, F.struct(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))))
    pair = top.groupBy(F.col("l_orderkey").alias("ok")).agg(of(1).alias("a"), of(2).alias("b")).where("a.s <> b.s")
    won = F.when(F.col("a.e") >= F.col("b.e"), F.struct(F.col("a").alias("w"), F.col("b").alias("l"))).otherwise(F.struct(F.col("b").alias("w"), F.col("a").alias("l")))
    sides = pair.select("ok", won.alias("z")).select("ok", *[F.col(f"z.{x}.{c}").alias(x + c) for x in "wl" for c in "spq"])
    dated = orders.select(F.col("o_orderkey").alias("ok"), F.col("o_orderdate").alias("od"), F.substring("o_orderpriority", 1, 1).alias("d1"))
    return sides.join(dated, "ok").selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()])


MATCHES_SQL = f"""
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem),
sides AS (SELECT a.l_orderkey AS ok, {", ".join(f"CASE WHEN a.l_extendedprice >= b.l_extendedprice THEN {x}.l_{c} ELSE {y}.l_{c} END AS {n}{c[0]}" for n, x, y in (("w", "a", "b"), ("l", "b", "a")) for c in ("suppkey", "partkey", "quantity"))}
          FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2 WHERE a.l_suppkey <> b.l_suppkey),
dated AS (SELECT s.*, o_orderdate AS od, substr(o_orderpriority, 1, 1) AS d1 FROM sides s JOIN orders ON o_orderkey = ok),
matches AS (SELECT {", ".join(f"{e} AS {n}" for n, e in COLUMNS.items())} FROM dated)"""

#: Types of a season file as published: one row per match, winner_ and loser_ columns.
SEASON_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("tourney_id", "tourney_name", "surface", "tourney_level", "round", "winner_name", "loser_name", "winner_hand", "loser_hand")]
    + [T.StructField(n, T.IntegerType()) for n in ("tourney_date", "match_num", "best_of", "draw_size")]
    + [T.StructField(n, T.DoubleType()) for n in ("minutes", *(f"{s}_{c}" for s in ("winner", "loser") for c in ("rank", "rank_points", "age", "ht", "seed")), *(f"{x}_{c}" for x in "wl" for c in ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")))]
)


def read_seasons(spark: SparkSession, folder: str, years: Sequence[int], tour: str = "atp", columns: Sequence[str] | None = None, required: bool = True) -> DataFrame:
    """``{tour}_matches_{year}.csv`` of the years in one scan, with ``season``; columns are found by header, missing ones are null.

    A missing file raises where ``required``, else it is left out with a warning.
    """
    kinds = {f.name: "date" if f.name == "tourney_date" else f.dataType.simpleString() for f in SEASON_SCHEMA}
    wanted = [c for c in columns or kinds if c in kinds]
    out = read_years(spark, folder, f"{tour}_matches_{{year}}.csv", years, Feed(kinds, "match_num"), wanted, required)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.DateType() if kinds[c] == "date" else SEASON_SCHEMA[c].dataType) for c in wanted] + [T.StructField("season", T.IntegerType())]))
    return out


def clean(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows with none of the required columns null; a missing column raises."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.na.drop(subset=list(required))


def write_seasons(df: DataFrame, folder: str, mode: str = "ignore", fmt: str = "parquet") -> None:
    """One folder per season, so that a scan of some seasons prunes the others; ``ignore`` keeps what is there."""
    df.repartition("season").write.mode(mode).partitionBy("season").format(fmt).save(folder)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key: values of ``old`` where they are filled, else those of ``new``; keys of either side."""
    b = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    joined = old.join(b, old[key] == b[f"_n_{key}"], "full_outer")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_n_{c}")).alias(c) if c in new.columns else F.col(c) for c in old.columns])
