"""Places in a total order over all rows, without a task that sees them all.

Rows are dealt by ranges of the order and sorted inside each range; a row's place is its place in the range plus the rows
of the ranges before it. The counts per range are one row per partition, whatever the table's size.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from boutlog.session import stored

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def numbered(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df, stored, with ``name``: the 0-based place of each row in the order.

    One shuffle by ranges. Rows that tie in all of ``order`` get neighbouring places in no stated order, so give a key as the
    last column. Rows are stored once sorted, so a lost executor cannot number them anew. An empty table stays empty. df is
    evaluated twice, as ranges are found from a sample of it: store it before, where that is dear.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = ranged.withColumns({"_range": F.shiftright("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    sizes = sorted(tuple(r) for r in placed.groupBy("_range").agg(F.count("*")).collect())  # one row per range
    before = [(r, sum_ - size) for (r, size), sum_ in zip(sizes, accumulate(size for _, size in sizes))]
    offsets = df.sparkSession.createDataFrame(before, "_range long, _before long")
    out = placed.join(F.broadcast(offsets), "_range").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_row")).alias(name))
    out._stored_in = ranged._stored_in
    return out


def shuffled(df: DataFrame, keys: list[str], seed: int = 42, name: str = "place") -> DataFrame:
    """df, stored, with ``name``: a random place that depends on the seed and the keys alone, however the rows are partitioned."""
    salted = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    return numbered(df.withColumn("_salted", salted), ["_salted", *keys], name).drop("_salted")
