"""Bounded samples of rows, for fitting classifiers: chosen by a hash of the id, so the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def first_by_hash(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hashes."""
    return ids.orderBy(F.xxhash64(key), key).limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """ids (bounded by first_by_hash) with the texts; documents are filtered where they are read."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).dropna(subset=[key]).join(F.broadcast(ids), key)
