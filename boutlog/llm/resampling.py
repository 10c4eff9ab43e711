"""Importance resampling towards a target distribution, over hashed word runs.

Features of a text are its runs of one to ``order`` words. One scan keeps the running zlib states of the last ``order`` starts
(a ring): each word extends every state by a space and itself and begins one more, and each state so reached is a feature's
crc32; its remainder is the bucket. Nothing is joined or hashed twice, and what is kept of a text between words is the ring.

A first pass counts buckets over all documents and all target texts (a table of ``buckets`` counts per task, summed by Spark);
the gains, one number per bucket, are all that is broadcast. A second pass sums the gains of each document's features. Draws
are by a Gumbel key made from the id, so that they depend on nothing but the id, the seed and the weight; the places of the
highest scores come from ranges of the score order (boutlog.operators.ordering), not from one task.

A null or empty text, or one without a word, has no features: weight 0, drawn never, as it has under ``least_words`` words.
A null id is hashed as the empty text and comes last among ties; rows equal in id and score are placed next to each other in
either order. Repeated rows count and are drawn each on its own. Without documents there are no rows; without target texts
the gains come from the documents' counts alone. Other columns are not looked at. A very long text is held whole in the
task that reads it, its words in parts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boutlog.operators.ordering import numbered
from boutlog.session import discard, stored

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
PART = 1 << 15  # words whose states are made at a time
#: Digits, letters and all bytes of longer characters are word bytes (A-Z lower-cased); all others separate.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def crc_ring(words: list[bytes], order: int = ORDER) -> Iterator[list[int]]:
    """crc32 of all runs of 1 to ``order`` words, joined by a space; ``PART`` words at a time.

    The states that reach the last word of a part are the ring, from which the next part goes on.
    """
    ring: list[list[int]] = [[] for _ in range(order)]  # ring[k]: the state of k + 1 words up to the last one, if there are as many
    crc = zlib.crc32
    for at in range(0, len(words), PART):
        some = words[at : at + PART]
        spaced = [b" " + w for w in some]
        states = [list(map(crc, some))]
        yield states[0]
        for k in range(1, order):
            earlier = ring[k - 1] + states[-1][:-1]  # the states of one word less up to the word before
            states.append(list(map(crc, spaced[len(some) - len(earlier) :], earlier)))
            yield states[-1]
        ring = [s[-1:] for s in states]


def buckets_of(text: bytes, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, Iterator[np.ndarray]]:
    """The number of words, and the buckets of all features in parts."""
    words = text.translate(WORDS).split()
    return len(words), (np.array(part, np.uint32) % np.uint32(buckets) for part in crc_ring(words, order) if part)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(texts: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in _texts(batch.column(0)):
                for part in buckets_of(t, order, buckets)[1]:
                    total += np.bincount(part, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 * ln of its smoothed share in the target over that in the documents)."""
    counts = np.zeros((2, buckets), np.int64)
    for row, table in zip(counts, (docs, target)):
        for r in bucket_counts(table, text, order, buckets).collect():  # one number per bucket
            row[r["bucket"]] = r["n"]
    s, t = (int(c.sum()) for c in counts)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + buckets) / (float(a + 1) * float(t + buckets)))) for a, b in zip(*counts.tolist())], np.int64)


def weights(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, n_words, n_features, weight (the sum of its features' gains) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[int], ...] = ([], [], [])
            for t in _texts(batch.column(1)):
                words, parts = buckets_of(t, order, len(table))
                n, w = 0, 0
                for part in parts:
                    n += len(part)
                    w += int(table[part].sum())
                for column, value in zip(out, (words, n, w)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["id", "n_words", "n_features", "weight"])

    made = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return made.withColumnRenamed("id", key)


def gumbel(key: str, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of sha256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null where it is not drawn."""
    table = gains(docs, target, text, order, buckets)
    scored = weights(docs, table, key, text, order).withColumn("score", F.col("weight") + gumbel(key, seed))
    scored = stored(scored.withColumn("_short", F.col("n_words") < least_words))  # finding ranges would scan the texts once more
    placed = numbered(scored, ["_short", F.col("score").desc(), F.col(key).asc_nulls_last()], "_place")
    discard(scored)
    drawn = percent * placed.where("NOT _short").count() // 100
    return placed.select(key, "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
