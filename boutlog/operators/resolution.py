"""Entity resolution: key sets of names, interval joins, best candidates, one use of each row."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.session import discard, stored

WINDOW_DAYS = (-3, 27)
_LATIN = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07))
#: Letters that have no decomposition, folded to the plain letter they look like.
STROKED = {"đ": "d", "ł": "l", "ø": "o", "ı": "i"}


def _plain(c: int) -> str:
    """The ASCII part of a character's compatibility decomposition, lower-cased."""
    return unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode().lower()


def _folding() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII with a plain form: those of one letter, over the basic plane, and Latin ones of several."""
    one = {chr(c): p for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(p := _plain(c)) == 1} | STROKED
    return one, {chr(c): p for c in _LATIN if len(p := _plain(c)) > 1}


_ONE, _SEVERAL = _folding()


def normalized(name: Column) -> Column:
    """Lower case, letters without their accents, hyphens, apostrophes and dots as blanks, single blanks; other characters go."""
    low = F.lower(name)
    for letter, plain in _SEVERAL.items():
        low = F.replace(low, F.lit(letter), F.lit(plain))
    low = F.translate(low, "".join(_ONE) + "-'.", "".join(_ONE.values()) + "   ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\x00-\x7f]", ""), r"\s+", " "))


def _glued(names: Column) -> Column:
    return F.array_distinct(F.concat(names, F.transform(names, lambda s: F.replace(s, F.lit(" "), F.lit("")))))


def full_name_keys(name: Column) -> Column:
    """Keys ``surname|initial`` of "First Sur Name": every run of the later words, and reversed order."""
    t = F.split(normalized(name), " ")
    n = F.size(t)
    runs = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(t, i, j - i + 1), " "))))
    back = F.transform(F.sequence(F.lit(1), n - 1), lambda j: F.array_join(F.slice(t, F.lit(1), j), " "))
    keyed = lambda names, of: F.transform(_glued(names), lambda s: F.concat(s, F.lit("|"), F.substring(of, 1, 1)))
    return F.when(n >= 2, F.array_distinct(F.concat(keyed(runs, F.element_at(t, 1)), keyed(back, F.element_at(t, -1)))))


def short_name_keys(name: Column) -> Column:
    """Keys of "Surname I.": words without a dot are the surname, the first with one gives the initial."""
    t = F.split(F.trim(name), r"\s+")
    surname = normalized(F.array_join(F.filter(t, lambda w: ~w.contains(".")), " "))
    initial = F.substring(normalized(F.element_at(F.concat(F.filter(t, lambda w: w.contains(".")), F.array(F.lit(""))), 1)), 1, 1)
    return F.when((surname != "") & (initial != ""), F.transform(_glued(F.array(surname)), lambda s: F.concat(s, F.lit("|"), initial)))


def same_names(full: DataFrame, short: DataFrame, surnames_only: bool = False) -> DataFrame:
    """full, short: the pairs of names (columns of that name) that share a key; each distinct name is taken apart once."""
    bare = (lambda k: F.array_distinct(F.transform(k, lambda s: F.substring_index(s, "|", 1)))) if surnames_only else (lambda k: k)
    a = full.distinct().select("full", F.explode(bare(full_name_keys(F.col("full")))).alias("_key"))
    b = short.distinct().select("short", F.explode(bare(short_name_keys(F.col("short")))).alias("_key"))
    return a.join(b, "_key").select("full", "short").distinct()


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def _months(day: Column, days: tuple[int, int]) -> Column:
    return F.sequence(_month(F.date_add(day, days[0])), _month(F.date_add(day, days[1])))


def candidates(matches: DataFrame, feed: DataFrame, days: tuple[int, int] = WINDOW_DAYS, surnames_only: bool = False) -> DataFrame:
    """match_num, feed_id, agreement (ranks that agree, 0 to 2), day_gap of name matches within the window of days.

    matches: match_num, tourney_date, w_name, l_name, w_rank, l_rank. feed: feed_id, feed_date, w_short, l_short, w_rank, l_rank.
    Names are resolved first, each distinct one once; then an equi-join on both players' names in the feed and the month: a feed row
    stands in its own, a match in those its window reaches, so that no pair comes twice. Days are a residual condition, so two
    players who meet for years do not pair all their matches with all their feed rows.
    """
    names = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("name")).where("name IS NOT NULL")
    same = same_names(names(matches, "w_name", "l_name").withColumnRenamed("name", "full"), names(feed, "w_short", "l_short").withColumnRenamed("name", "short"), surnames_only)
    of = lambda x: same.select(F.col("full").alias(f"{x}_name"), F.col("short").alias(f"{x}_short"))
    a = matches.join(of("w"), "w_name").join(of("l"), "l_name").withColumn("_m", F.explode(_months(F.col("tourney_date"), days)))
    a = a.select("match_num", "tourney_date", "_m", "w_short", "l_short", F.col("w_rank").alias("_wr"), F.col("l_rank").alias("_lr"))
    b = feed.select("feed_id", "feed_date", _month(F.col("feed_date")).alias("_m"), "w_short", "l_short", "w_rank", "l_rank")
    gap = F.datediff("feed_date", "tourney_date")
    agree = F.coalesce((F.col("w_rank") == F.col("_wr")).cast("int"), F.lit(0)) + F.coalesce((F.col("l_rank") == F.col("_lr")).cast("int"), F.lit(0))
    return a.join(b, ["w_short", "l_short", "_m"]).where(gap.between(*days)).select("match_num", "feed_id", agree.alias("agreement"), gap.alias("day_gap"))


def best(pairs: DataFrame) -> DataFrame:
    """The best candidate of each match: the first stage (where pairs have one), most agreement, then nearest date, then least id."""
    more = [c for c in ("stage",) if c in pairs.columns]
    order = F.struct(*more, (-F.col("agreement")).alias("x"), F.abs("day_gap").alias("y"), F.col("feed_id").alias("z"))
    return pairs.groupBy("match_num").agg(F.min_by(F.struct("feed_id", "agreement", "day_gap", *more), order).alias("b")).select("match_num", "b.*")


def assign_once(pairs: DataFrame) -> DataFrame:
    """Each match its best feed row that no earlier match took (match order is match_num).

    All feed rows prefer the earlier match, so the one stable assignment equals serving matches in turn. It is found
    in rounds: every open match asks for its best row left; a row goes to the earliest asker. Each round is two
    grouped minima; a row once held can only pass to an earlier match, and leaves the lists of those it turned down.
    """
    left = stored(pairs)
    while True:  # every round but the last takes a pair away
        asked = stored(best(left))
        given = asked.groupBy("feed_id").agg(F.min("match_num").alias("_to"))
        refused = stored(asked.join(given, "feed_id").where("match_num <> _to").select("match_num", "feed_id"))
        if refused.isEmpty():
            discard(left, refused)
            return asked
        rest = stored(left.join(refused, ["match_num", "feed_id"], "left_anti"))
        discard(left, asked, refused)
        left = rest


def _families(same: DataFrame) -> DataFrame:
    """full, short, family of the pairs of names (stored): names that are linked by any chain of pairs share the family."""
    out = stored(same.withColumn("family", F.col("short")))
    while True:  # every round but the last lowers a family
        lower = out.withColumn("_f", F.min("family").over(Window.partitionBy("full")))
        moved = stored(lower.withColumn("_g", F.min("_f").over(Window.partitionBy("short"))))
        discard(out)
        out = moved.select("full", "short", F.col("_g").alias("family"))
        out._stored_in = moved._stored_in
        if moved.where("_g <> family").isEmpty():
            return out


def _served(batches: Iterator[pa.RecordBatch], days: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Serves matches in turn. Rows come by pair of families, in it first the feed's (greatest id first), then the matches by number.

    A feed row stands, by day, under its names, under them with either rank and with both, so a match finds its best row left
    without a look at the others. What is held is the feed rows of one pair of families.
    """
    pair, held, taken = None, {}, set()

    def nearest(places: list[tuple], day: int) -> tuple[int, int, int] | None:
        found = []
        for by_day in filter(None, map(held.get, places)):
            for at in by_day if len(by_day) <= days[1] - days[0] else range(day + days[0], day + days[1] + 1):
                ids = by_day.get(at)
                while ids and ids[-1] in taken:
                    ids.pop()
                if ids and days[0] <= at - day <= days[1]:
                    found.append((abs(at - day), ids[-1], at - day))
        return min(found, default=None)

    for batch in batches:
        out = []
        for family, is_match, number, day, wr, lr, w, l, w2, l2 in zip(*(batch.column(c).to_pylist() for c in ("family", "is_match", "number", "day", "wr", "lr", "w", "l", "w2", "l2"))):  # noqa: E741
            if family != pair:
                pair, held, taken = family, {}, set()
            names, surnames = list(itertools.product(w or (), l or ())), list(itertools.product(w2 or (), l2 or ()))
            by_one = [(n, "w", wr) for n in names if wr is not None] + [(n, "l", lr) for n in names if lr is not None]
            by_both, bare = ([(n, wr, lr) for n in names], [(n, "bare", wr, lr) for n in surnames]) if wr is not None and lr is not None else ([], [])
            levels = ((1, 2, by_both), (1, 1, by_one), (1, 0, [(n,) for n in names]), (2, 2, bare))
            if not is_match:
                for place in (x for _, _, places in levels for x in places):
                    held.setdefault(place, {}).setdefault(day, []).append(number)
                continue
            for stage, agreement, places in levels:
                if best_ := nearest(places, day):
                    taken.add(best_[1])
                    out.append((number, best_[1], agreement, best_[2], stage))
                    break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["match_num", "feed_id", "agreement", "day_gap", "stage"])


def match_once(matches: DataFrame, feed: DataFrame, days: tuple[int, int] = WINDOW_DAYS, fallback: bool = False) -> DataFrame:
    """assign_once(candidates(matches, feed, days)) without the candidate pairs, whose number grows with the square of the rows.

    With ``fallback`` a match without a row left by full keys takes one by surnames alone where both ranks agree (stage 2). Only
    matches and feed rows whose names are linked, directly or not, can compete, so rows are dealt by their pair of families of
    names, sorted there (with spill) and streamed in turn; different pairs run side by side. match_num and feed_id are keys.
    """
    matches, feed = stored(matches), stored(feed)
    names = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("name")).where("name IS NOT NULL")
    full, short = names(matches, "w_name", "l_name").toDF("full").distinct(), names(feed, "w_short", "l_short").toDF("short").distinct()
    same = _families(same_names(full, short, fallback))
    exact = same_names(full, short).groupBy("full").agg(F.collect_set("short").alias("same"))
    bare = F.array_join(F.array_sort(F.array_distinct(F.transform(short_name_keys(F.col("short")), lambda s: F.substring_index(s, "|", 1)))), "|")
    none = F.array().cast("array<string>")
    known = same.groupBy("full").agg(F.min("family").alias("family"), F.collect_set(bare if fallback else F.lit(None).cast("string")).alias("bare")).join(exact, "full", "left")
    fed = same.select("short", "family", F.array("short").alias("same"), (F.array(bare) if fallback else none).alias("bare")).distinct()

    def rows(df: DataFrame, table: DataFrame, by: str, suffix: str, number: str, day: str, is_match: bool) -> DataFrame:
        of = lambda x: table.select(F.col(by).alias(f"{x}_{suffix}"), F.col("family").alias(f"_{x}"), F.col("same").alias(x), F.col("bare").alias(f"{x}2"))
        named = df.where(F.col(day).isNotNull()).join(of("w"), f"w_{suffix}").join(of("l"), f"l_{suffix}")
        rank = lambda x: F.col(f"{x}_rank").cast("long").alias(f"{x}r")
        return named.select(F.xxhash64("_w", "_l").alias("family"), F.lit(is_match).alias("is_match"), F.col(number).cast("long").alias("number"), F.unix_date(day).alias("day"), rank("w"), rank("l"), "w", "l", "w2", "l2")

    both = rows(feed, fed, "short", "short", "feed_id", "feed_date", False).unionByName(rows(matches, known, "full", "name", "match_num", "tourney_date", True))
    turn = F.when(F.col("is_match"), F.col("number")).otherwise(-F.col("number"))
    return both.repartition("family").sortWithinPartitions("family", "is_match", turn).mapInArrow(lambda batches: _served(batches, days), "match_num long, feed_id long, agreement int, day_gap int, stage int")


def with_fallback(matches: DataFrame, feed: DataFrame, days: tuple[int, int] = WINDOW_DAYS) -> DataFrame:
    """Each match one feed row that no earlier match took: by full keys (stage 1), else by surnames alone where both ranks agree (stage 2)."""
    return match_once(matches, feed, days, True)


def unmatched(matches: DataFrame, found: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n most frequent values of ``by`` among matches that were not found."""
    return matches.join(found, "match_num", "left_anti").groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def unique_either_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, other of rows whose two names' full_name_keys meet in one orientation or the other, where just one row does.

    a: id, day, n1, n2; b: other, day, n1, n2 (full names); id and other are keys. Each distinct name is taken apart once. Rows of b
    with equal day and names become one with their count, rows of a one without, and only those classes are joined, so rows are
    never multiplied by the rows of their day; a class of a that meets one row in all gives it to its rows.
    """
    keyed = lambda df, n: df.select(F.explode(F.array("n1", "n2")).alias(n)).distinct().select(n, F.explode(full_name_keys(F.col(n))).alias("_key"))
    meet = stored(keyed(a, "s").join(keyed(b, "t"), "_key").select("s", "t").distinct())
    of = lambda i: meet.select(F.col("s").alias(f"n{i}"), F.col("t").alias(f"t{i}"))
    classes = a.select("day", "n1", "n2").distinct().join(of(1), "n1").join(of(2), "n2")
    turned = classes.select("day", "n1", "n2", F.inline(F.array(*[F.struct(F.col(f"t{i}").alias("o1"), F.col(f"t{j}").alias("o2")) for i, j in ((1, 2), (2, 1))]))).distinct()
    counted = b.groupBy("day", F.col("n1").alias("o1"), F.col("n2").alias("o2")).agg(F.count_distinct("other").alias("n"), F.min("other").alias("other"))
    single = turned.join(counted, ["day", "o1", "o2"]).groupBy("day", "n1", "n2").agg(F.sum("n").alias("n"), F.min("other").alias("other")).where("n = 1")
    return a.join(single.drop("n"), ["day", "n1", "n2"]).select("id", "other")


def candidate_days(matches: DataFrame, days: tuple[int, int] = (0, 3)) -> DataFrame:
    """match_num, day: the days on which a match's feed row may stand, around its own."""
    return matches.select("match_num", F.explode(F.sequence(F.date_add("tourney_date", days[0]), F.date_add("tourney_date", days[1]))).alias("day"))


def search_days(matches: DataFrame, known: str = "td_date", around: int = 1, window: int = 14) -> DataFrame:
    """match_num, day, turn: where a match's day is known, that day, the one before and the one after; else all days of the window from the tournament's first on."""
    near = F.transform(F.sequence(F.lit(-around), F.lit(around)), lambda i: F.struct(F.date_add(F.col(known), i).alias("day"), F.when(i == 0, 0).otherwise(2 * F.abs(i) - F.when(i < 0, 1).otherwise(0)).alias("turn")))
    wide = F.transform(F.sequence(F.lit(0), F.lit(window)), lambda i: F.struct(F.date_add(F.col("tourney_date"), i).alias("day"), i.alias("turn")))
    return matches.select("match_num", F.inline(F.when(F.col(known).isNotNull(), near).otherwise(wide)))


def page_rows(html: Column) -> Column:
    """The table rows of a day's page as (href, team1, team2): the row's first link and the two names of its text, apart by a dash."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr(.*?)</tr>"), F.lit(1))

    def read(r: Column) -> Column:
        names = F.split(F.trim(F.regexp_replace(F.regexp_extract(r, r"(?s)<a [^>]*>(.*?)</a>", 1), r"<[^>]*>", "")), r"\s+-\s+")
        return F.struct(F.regexp_extract(r, 'href="([^"]*)"', 1).alias("href"), F.get(names, 0).alias("team1"), F.get(names, 1).alias("team2"))

    return F.filter(F.transform(rows, read), lambda x: x["team2"].isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, href of every link of a page's html."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def price_cells(payload: Column) -> Column:
    """Of a JSON payload ``{"odds": "<table>..."}`` the rows' text as an array of (book, price1, price2) strings."""
    html = F.get_json_object(payload, "$.odds")
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.struct(F.regexp_extract(r, r'data-book="([^"]*)"', 1).alias("book"), F.get(F.regexp_extract_all(r, F.lit(r'data-odd="([0-9.]+)"'), F.lit(1)), F.lit(0)).alias("price1"), F.get(F.regexp_extract_all(r, F.lit(r'data-odd="([0-9.]+)"'), F.lit(1)), F.lit(1)).alias("price2")))


__all__ = ["assign_once", "best", "candidates", "full_name_keys", "match_once", "normalized", "page_links", "price_cells", "short_name_keys", "unique_either_way", "unmatched", "with_fallback"]
