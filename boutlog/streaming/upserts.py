"""An incremental table: micro-batches of rows are merged by key into a folder partitioned by season.

A batch is read once, rows of one key in it become one, and only the partitions that it touches are read, merged and
overwritten. Columns derived from others are computed anew after each merge. A merge keeps what is filled, so the same batch
twice gives the same table: a batch that is replayed after a failure (of the driver or between the partitions' renames) ends
in the state that one run gives. New columns of a later batch (one more bookmaker) are null in rows that lack them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boutlog.session import discard, stored

Refresh = Callable[[DataFrame], DataFrame]


def _is(part: str, values: Sequence) -> Column:
    """Whether part is one of the values, null among them."""
    out = F.col(part).isin([v for v in values if v is not None])
    return out | F.col(part).isNull() if None in values else out


def read_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as it is; None before its first batch. Files of fewer columns give nulls."""
    try:
        return spark.read.option("mergeSchema", True).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def one_per_key(batch: DataFrame, key: str, part: str, order: str) -> DataFrame:
    """One row per key: of each column the first filled value in the order (without one: last; ties: the least value); rows without a key are left out."""
    others = [c for c in batch.columns if c not in (key, part, order)]
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).isNull().alias("o0"), F.col(order).alias("o1"), F.col(c).alias("v"))))["v"].alias(c) for c in others]
    return batch.where(F.col(key).isNotNull()).repartition(part, key).groupBy(part, key).agg(*first)  # dealt first: one sort, as keys rarely meet before


def merged(old: DataFrame | None, new: DataFrame, key: str, part: str, derived: Sequence[str] = ()) -> DataFrame:
    """Rows of either side by part and key: values of ``old`` where they are filled, else those of ``new``; derived columns are left out."""
    new = new.drop(*derived)
    if old is None:
        return new
    old = old.drop(*derived)
    both = [c for c in old.columns if c not in (key, part)]
    more = [c for c in new.columns if c not in (key, part) and c not in both]
    a = old.select(F.col(part).alias("_ap"), F.col(key).alias("_ak"), F.struct(F.lit(1), *both).alias("a"))
    b = new.select(F.col(part).alias("_bp"), F.col(key).alias("_bk"), F.struct(F.lit(1), *[c for c in new.columns if c not in (key, part)]).alias("b"))
    joined = a.join(b, (F.col("_ap").eqNullSafe(F.col("_bp"))) & (F.col("_ak") == F.col("_bk")), "full_outer")
    value = lambda c: F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")) if c in new.columns else F.col(f"a.`{c}`")
    return joined.select(F.coalesce("_ap", "_bp").alias(part), F.coalesce("_ak", "_bk").alias(key), *[value(c).alias(c) for c in both], *[F.col(f"b.`{c}`").alias(c) for c in more])


def merge_batch(batch: DataFrame, folder: str, key: str, part: str, order: str, refresh: Refresh | None = None) -> None:
    """Merge a batch into the table in ``folder``; refresh(rows) adds the derived columns.

    The partitions that merged rows come from are the ones overwritten: Spark writes all new files beside them before it puts them
    in place, so rows are written once. What is collected are the parts that a batch touches. An empty batch changes nothing.
    """
    spark = batch.sparkSession
    new = stored(one_per_key(batch, key, part, order))
    touched = [r[0] for r in new.select(part).distinct().collect()]
    if touched:
        table = read_table(spark, folder)
        old = None if table is None else table.where(_is(part, touched))
        derived = [c for c in refresh(new).columns if c not in new.columns] if refresh else []
        rows = merged(old, new, key, part, derived)
        out = refresh(rows) if refresh else rows
        out.repartition(part, F.pmod(F.xxhash64(key), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)
    discard(new)


def upsert_stream(feed: DataFrame, folder: str, checkpoint: str, key: str, part: str, order: str, refresh: Refresh | None = None) -> None:
    """Merge all new rows of a stream into the table and end; the checkpoint knows what was merged before."""

    def run(batch: DataFrame, _: int) -> None:
        merge_batch(batch, folder, key, part, order, refresh)

    feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
