"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each text is measured over all its words and lines. Per language and source the measures go into quantile
sketches: counts in bins whose edges grow by ``GROWTH``, so that a quantile is at most that factor too high.
Sketches merge by adding counts: from tasks to the group, from groups of a language to the language (for groups
of fewer than ``min_rows`` rows), from languages to all, always with the same result. A row's threshold on a
measure is its group's 0.9 quantile plus ``spread`` times the distance from the median to it, or ``spread``
times the least step that the row itself can measure (one symbol, one line, the six words of one repeated
window), if that is larger. Thresholds are joined back and rows beyond any of them are rejected.

The measures are shares, so that long and short texts are judged alike: symbols per word character,
repeated lines per word-bearing line, repeated words, upper-case letters per word character, bars and
exclamation marks per word, mean length of words.

Null texts have no words and fail the base rule; so do empty ones. Null languages and sources form groups of
their own. Repeated rows count as often as they occur. An empty table gives no rows; other columns are kept
or, where they bear the name of a measure, replaced. A very long text is held whole in the task that reads it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.session import discard, stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: measure -> what it is a share of, and the least step of what is counted.
FLOORS = {"symbol_share": ("word_chars", 1), "dup_line_share": ("n_lines", 1), "repeat_share": ("n_words", 6), "upper_share": ("word_chars", 1), "mark_share": ("n_words", 1), "word_length": ("n_words", 1)}
MIDDLE, HIGH, SPREAD, MIN_ROWS, GROWTH = 0.5, 0.9, 4.0, 30, 1.02
_ZERO = -(1 << 30)  # the bin of values that are not above zero
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BROADCAST_ROWS = 20_000


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts, n_lines, base_failed and the shares of FLOORS.

    Cut or store the result before filtering on it: a filter pushed below the measures would evaluate them again and again.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.translate(t, SPACE, " " * len(SPACE)), " "), lambda x: x != "")
    step = docs.drop(*COUNTS, *FLOORS, "n_lines", "base_failed").withColumn("_w", words)
    window = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    step = step.withColumn("_h", F.slice(window, 1, F.greatest(F.size("_w") - 2, F.lit(0))))
    # places of windows that occur again, found by sorting (hash, place): neighbours are equal
    sorted_ = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), sorted_).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter("_s", lambda x, k: (F.get("_s", k - 1)["h"].eqNullSafe(x["h"]) & (k > 0)) | F.get("_s", k + 1)["h"].eqNullSafe(x["h"]))
    step = step.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    dropped = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    step = step.withColumn("_l", lines)
    step = step.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": dropped(SYMBOLS),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": covered,
            "n_lines": F.size("_l").cast("long"),
            "_upper": dropped("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_marks": dropped("|!{}[]\\^~"),
        }
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    step = step.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("_upper", "word_chars"),
            "mark_share": share("_marks", "n_words"),
            "word_length": share("word_chars", "n_words"),
        }
    )
    return step.drop("_w", "_h", "_s", "_p", "_l", "_upper", "_marks")


def _bin(c: Column) -> Column:
    return F.when(c > 0, F.floor(F.ln(c) / math.log(GROWTH)).cast("int")).otherwise(_ZERO)


def _value(bin_: Column) -> Column:
    return F.when(bin_ == _ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), bin_ + 1))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, m (the number of a measure), bin, n: counts of the rows that pass the base rule."""
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("m"), _bin(F.col(m)).alias("bin")) for i, m in enumerate(FLOORS)]))
    return measured.where("NOT base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), each).groupBy("lang", "source", "m", "bin").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, n (rows), and struct(middle, high) of each measure, of sketches merged by the given columns."""
    merged = sketch.groupBy(*by, "m", "bin").agg(F.sum("n").alias("n"))
    all_ = Window.partitionBy(*by, "m")
    summed = merged.withColumns({"upto": F.sum("n").over(all_.orderBy("bin")), "total": F.sum("n").over(all_)})
    at = lambda i, q: _value(F.min(F.when((F.col("m") == i) & (F.col("upto") >= q * F.col("total")), F.col("bin"))))
    return summed.groupBy(*by).agg(F.max("total").alias("n"), *[F.struct(at(i, MIDDLE).alias("middle"), at(i, HIGH).alias("high")).alias(m) for i, m in enumerate(FLOORS)])


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """_lang, _source, and for each measure t_<measure>, struct(middle, high); rows that fail the base rule are left out of the sketches."""
    sketch = stored(sketches(measured, lang, source))
    renamed = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    # as many rows as groups of language and source, each with its language's quantiles and those of all
    table = _quantiles(sketch, "lang", "source").join(renamed(_quantiles(sketch, "lang"), "l_"), F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(renamed(_quantiles(sketch), "a_")))
    of = lambda m: F.when(F.col("n") >= min_rows, F.col(m)).when(F.col("l_n") >= min_rows, F.col(f"l_{m}")).otherwise(F.col(f"a_{m}"))
    out = stored(table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[of(m).alias(f"t_{m}") for m in FLOORS]))
    discard(sketch)
    return out


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", spread: float = SPREAD) -> DataFrame:
    """measured with kept; a row whose group has no thresholds failed the base rule."""
    size = limits.limit(BROADCAST_ROWS + 1).count()
    within = F.lit(True)
    for m, (of, step) in FLOORS.items():
        t = F.col(f"t_{m}")
        limit = t["high"] + spread * F.greatest(t["high"] - t["middle"], F.lit(float(step)) / F.greatest(F.col(of), F.lit(1)))
        within = within & (F.col(m) <= F.coalesce(limit, F.lit(float("inf"))))
    on = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    joined = measured.join(F.broadcast(limits) if size <= BROADCAST_ROWS else limits, on, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("_lang", "_source", *[f"t_{m}" for m in FLOORS])
