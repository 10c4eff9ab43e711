"""Evaluation of predictions: match-level accuracy, calibration, slices with intervals, paired comparisons."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from boutlog.functions.columns import AGE_GAPS, FORM_GAPS, RANK_GAPS, binned, mcnemar_z, sorted_pair, wilson

EPS, BINS = 1e-15, 10
SLICES = ("surface", "level", "best_of", "round", "hands", "rank_gap", "age_gap", "form_gap")


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def match_evaluation(scored: DataFrame, threshold: float = 0.5, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """match_num, prob (of the winner, averaged over both perspectives), correct: one group per match (and ``by``)."""
    mean = F.avg(F.when(F.col("y") == 1, F.col(p)).otherwise(1 - F.col(p)))
    return scored.groupBy("match_num", *by).agg(F.round(mean, 12).alias("prob")).withColumn("correct", (F.col("prob") > threshold).cast("int"))


def one_sided_evaluation(scored: DataFrame, threshold: float = 0.5, p: str = "p") -> DataFrame:
    """The older measure: the winner's perspective alone."""
    return scored.where("y = 1").select("match_num", F.col(p).alias("prob"), (F.col(p) > threshold).cast("int").alias("correct"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1, kappa."""
    said, true = F.col("p") > threshold, F.col("y") == 1
    n = lambda c: F.count_if(c)
    out = scored.agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & ~true).alias("tn"), n(~said & true).alias("fn"))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    out = out.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / total, "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (total * total)
    return out.withColumns({"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "kappa": F.try_divide(F.col("accuracy") - chance, 1 - chance)})


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half: labels are counted per score first, so what is ordered is one row per distinct score."""
    return auc_of(scored.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")))


def auc_of(counts: DataFrame, *by: str) -> DataFrame:
    """The same of p, a, b: the rows of label 1 and of label 0 with each score, in every group."""
    # scores are cut into ranges whose totals are summed up, so that no task sorts them all
    ranged = counts.withColumn("r", F.floor(F.col("p") * 4096))
    totals = ranged.groupBy(*by, "r").agg(F.sum("b").alias("n")).withColumn("_before", F.sum("n").over(Window.partitionBy(*by).orderBy("r")) - F.col("n")).drop("n")
    below = F.sum("b").over(Window.partitionBy(*by, "r").orderBy("p")) - F.col("b") + F.col("_before")
    return ranged.join(F.broadcast(totals), [*by, "r"]).select(*by, "a", "b", (F.col("a") * (below + F.col("b") / 2)).alias("won")).groupBy(*by).agg(F.try_divide(F.sum("won"), (F.sum("a") * F.sum("b")).cast("double")).alias("auc"))


def losses(scored: DataFrame, *by: str) -> DataFrame:
    """brier and log_loss."""
    p = clipped(F.col("p"))
    return scored.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), (-F.avg(F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))


def edges(n: int = BINS) -> list[float]:
    return [i * (1.0 / n) for i in range(n)] + [1.0]


def reliability(scored: DataFrame, n: int = BINS) -> DataFrame:
    """bin, lower, upper, n, predicted, observed, error of equal bins, left-closed; empty bins stay with nulls."""
    e = edges(n)
    at = F.lit(0)
    for i in range(1, n):
        at = F.when(F.col("p") >= F.lit(e[i]), i).otherwise(at)
    found = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("_n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    all_bins = scored.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(found, "bin", "left").select("bin", (F.col("bin") / n).alias("lower"), ((F.col("bin") + 1) / n).alias("upper"), F.coalesce("_n", F.lit(0)).alias("n"), "predicted", "observed", (F.col("predicted") - F.col("observed")).alias("error"))


def ece(scored: DataFrame, n: int = BINS) -> DataFrame:
    """Mean gap of the bins, weighted by their rows."""
    return reliability(scored, n).agg((F.sum(F.col("n") * F.abs("error")) / F.sum("n")).alias("ece"))


def slice_frame(evaluated: DataFrame) -> DataFrame:
    """The attributes to slice by, of match rows with hands, ranks, ages and forms of both sides."""
    gap = lambda c: F.abs(F.col(f"w_{c}") - F.col(f"l_{c}"))
    return evaluated.withColumns({"hands": sorted_pair(F.col("w_hand"), F.col("l_hand")), "rank_gap": binned(gap("rank"), RANK_GAPS), "age_gap": binned(gap("age"), AGE_GAPS), "form_gap": binned(F.round(gap("form"), 9), FORM_GAPS)})


def slices(frame: DataFrame, columns: Sequence[str] = SLICES, support: int = 5, degree: int = 2) -> DataFrame:
    """Metrics of every slice by one or two attributes with enough rows.

    Rows are first grouped by all attributes (sums, map-side), and the slices are grouping sets of those sums,
    so the rows themselves are never multiplied. A null value is a slice of its own.
    """
    p = F.col("prob")
    cells = frame.withColumns({c: F.col(c).cast("string") for c in columns}).groupBy(*columns).agg(
        F.count("*").alias("n"), F.sum("correct").alias("hits"), F.sum(p).alias("p"), F.sum(F.pow(1 - p, 2)).alias("b"), F.sum(-F.ln(clipped(p))).alias("l")
    )
    whole = cells.agg(F.sum("n").alias("all_n"), (F.sum("hits") / F.sum("n")).alias("all_accuracy"))
    sets = [list(s) for d in range(1, degree + 1) for s in itertools.combinations(columns, d)]
    grouped = cells.groupingSets(sets, *columns).agg(*[F.grouping(c).alias(f"g_{c}") for c in columns], *[F.sum(c).alias(c) for c in ("n", "hits", "p", "b", "l")]).where(F.col("n") >= support)
    label = F.concat_ws(" & ", *[F.when(F.col(f"g_{c}") == 0, F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("null")))) for c in columns])
    d = sum((1 - F.col(f"g_{c}") for c in columns[1:]), 1 - F.col(f"g_{columns[0]}"))
    low, high = wilson(F.col("hits"), F.col("n"))
    out = grouped.crossJoin(F.broadcast(whole))
    accuracy = F.col("hits") / F.col("n")
    return out.select(
        d.cast("int").alias("degree"), label.alias("slice"), F.col("n").alias("support"), (F.col("n") / F.col("all_n")).alias("support_share"), accuracy.alias("accuracy"), (1 - accuracy).alias("error_rate"),
        (accuracy - F.col("all_accuracy")).alias("gap"), low.alias("lower"), high.alias("upper"), (high < F.col("all_accuracy")).alias("below_overall"), (F.col("b") / F.col("n")).alias("brier"), (F.col("l") / F.col("n")).alias("log_loss"), (F.col("p") / F.col("n")).alias("mean_prob"),
    )


def worst_slices(table: DataFrame, gap: float = -0.05, n: int = 10) -> DataFrame:
    """Slices whose gap is at most ``gap``; the n lowest where there is none."""
    marked = table.crossJoin(F.broadcast(table.agg(F.count_if(F.col("gap") <= gap).alias("_hits"))))
    lowest = table.orderBy("gap", F.desc("support"), "slice").limit(n).select("slice", F.lit(True).alias("_low"))
    return marked.join(lowest, "slice", "left").where(F.when(F.col("_hits") > 0, F.col("gap") <= gap).otherwise(F.coalesce("_low", F.lit(False)))).drop("_hits", "_low")


def best_slices(table: DataFrame, n: int = 8) -> DataFrame:
    """The n slices of the greatest gap; of equal ones those of more rows, then by name."""
    return table.orderBy(F.desc("gap"), F.desc("support"), "slice").limit(n)


def gains_and_losses(compared: DataFrame, delta: str, n: int = 8) -> DataFrame:
    """kind (gain or loss), slice, support, delta: the n slices that a model improves most and least."""
    top = lambda kind, order: compared.orderBy(order, F.desc("support"), "slice").limit(n).select(F.lit(kind).alias("kind"), "slice", "support", F.col(delta).alias("delta"))
    return top("gain", F.desc(delta)).unionByName(top("loss", F.asc(delta)))


def worst_predictions(evaluated: DataFrame, n: int = 5) -> DataFrame:
    return evaluated.withColumn("error", 1 - F.col("prob")).orderBy(F.desc("error"), "match_num").limit(n)


def paired(base: DataFrame, other: DataFrame, carry: Sequence[str] = ("season",)) -> DataFrame:
    """match_num, carry, a (base right), b (other right)."""
    return base.select("match_num", *carry, F.col("correct").alias("a")).join(other.select("match_num", F.col("correct").alias("b")), "match_num")


def mcnemar(pairs: DataFrame, *by: str) -> DataFrame:
    """n, b (only base right), c (only the other right), accuracies, delta and z."""
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_base"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_other"), F.avg("a").alias("base_accuracy"), F.avg("b").alias("other_accuracy"))
    return out.withColumns({"delta": F.col("other_accuracy") - F.col("base_accuracy"), "z": mcnemar_z(F.col("only_base"), F.col("only_other"))})


def walk_forward(pairs: DataFrame) -> DataFrame:
    """mcnemar per season and pooled (season null), with the number of seasons that gained."""
    years = mcnemar(pairs, "season")
    gained = years.agg(F.count_if(F.col("delta") > 0).alias("gained"))
    pooled = mcnemar(pairs).withColumn("season", F.lit(None).cast("long"))
    return years.unionByName(pooled).crossJoin(F.broadcast(gained))


def delta_correlation(pairs: DataFrame) -> DataFrame:
    """Correlation over seasons of base accuracy and gain; null with one distinct base."""
    years = mcnemar(pairs, "season")
    return years.agg(F.when(F.count_distinct("base_accuracy") > 1, F.corr("base_accuracy", "delta")).alias("correlation"))


def summary(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, n, mean, std, min, max, range over runs (seeds, seasons)."""
    long = runs.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.stddev_pop("v").alias("std_pop"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("range"))


def compare_slices(tables: dict[str, DataFrame], base: str) -> DataFrame:
    """Slices of several models side by side: accuracies, deltas against ``base``, the best model (the first of equals).

    A slice (with its support) that some model lacks is an error, as the models were then not evaluated on the same matches.
    """
    long = None
    for i, (name, t) in enumerate(tables.items()):
        part = t.select("slice", "degree", "support", F.lit(i).alias("i"), F.lit(name).alias("model"), "accuracy")
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy("slice", "degree", "support").agg(*[F.max(F.when(F.col("model") == m, F.col("accuracy"))).alias(f"{m}_accuracy") for m in tables], F.max(F.struct("accuracy", (-F.col("i")).alias("i"), "model"))["model"].alias("best_model"), F.count("*").alias("_m"))
    unequal = F.raise_error(F.concat(F.lit("a slice that some models lack: "), F.col("slice"))).cast("boolean")
    full = wide.where(F.when(F.col("_m") == len(tables), F.lit(True)).otherwise(unequal)).drop("_m")
    return full.withColumns({f"{m}_delta": F.col(f"{m}_accuracy") - F.col(f"{base}_accuracy") for m in tables if m != base})
